import math

import numpy as np

from docmill.llm import scoring


def corpus():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        words = []
        for _ in range(int(rng.integers(20, 120))):  # each word tells the next ones
            k = int(rng.integers(12))
            words += [f"a{k}", f"b{k}", f"c{k}"]
        rows.append((i, " ".join(words)))
    return rows


def small(words, classes=(0, 1, 3, 5), buckets=3):
    return scoring.Vocabulary({w.encode(): i for i, w in enumerate(words)}, buckets, np.array(classes), np.log(np.full((256, 256), 1 / 256)))


def test_scores_against_a_plain_loop():
    v = small(["a", "b", "c", "d"])
    flat = scoring.first_parameters(v, 9)
    flat = flat + np.random.default_rng(8).standard_normal(len(flat)) * 0.3
    e, w1, b1, w2, b2, u, d = scoring.unpack(flat.astype(float), v)
    texts = (b"a B c zz d", b"", b"q", b"a a a b c d d")
    docs = [v.ids(t)[0] for t in texts]
    assert [round(v.ids(t)[1] / math.log(256)) for t in texts] == [-3, 0, -2, 0]  # two or one byte and the end
    got = scoring.score_texts([e, w1, b1, w2, b2, u, d], v, docs, most=3)
    for doc, total in zip(docs, got, strict=True):
        want = 0.0
        for i, word in enumerate(doc):
            around = [doc[i + o] if 0 <= i + o < len(doc) else v.outside for o in (-2, -1, 1, 2)]
            h = np.tanh(np.concatenate([e[a] for a in around]) @ w1 + b1)
            target = min(int(word), 4)
            c = max(k for k in range(3) if v.first[k] <= target)
            s, own = h @ w2 + b2, range(v.first[c], v.first[c + 1])
            z = np.array([h @ u[o] + d[o] for o in own])
            want += s[c] - math.log(np.exp(s).sum()) + z[target - own[0]] - math.log(np.exp(z).sum())
        assert abs(want - total) < 1e-9
    # All outcomes of one place add up to one.
    context = scoring.windows([docs[0]], v.outside)[0][:1]
    logs = scoring.log_probabilities([e, w1, b1, w2, b2, u, d], v.first, np.repeat(context, 5, axis=0), np.arange(5))
    assert abs(np.exp(logs).sum() - 1) < 1e-9


def test_learns_from_both_sides(spark):
    rows = corpus()
    rng = np.random.default_rng(4)
    mixed = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows[:40]]
    extra = [(5000, None), (5001, ""), (5002, " \n"), (None, "a1 b1"), (5003, rows[0][1]), (5003, rows[0][1]), (5004, "unseen words only")]
    df = spark.createDataFrame(rows + mixed + extra, "doc_id long, text string").selectExpr("*", "'i' as ids", "1 as n_tokens")
    out = scoring.score_documents(df, words=30, rounds=6).collect()
    assert len(out) == len(rows) + len(mixed) + len(extra)
    by = {r.doc_id: r for r in out}
    assert (by[5000].n_tokens, by[5000].pseudo_log_likelihood, by[5000].mean_log_probability) == (0, 0.0, None)
    assert by[5003].pseudo_log_likelihood == by[0].pseudo_log_likelihood and by[5004].n_tokens == 3
    ordered = np.mean([by[i].mean_log_probability for i in range(40)])
    shuffled = np.mean([by[1000 + i].mean_log_probability for i in range(40)])
    assert ordered > shuffled + 0.2


def test_descent_lowers_the_loss():
    rng = np.random.default_rng(0)
    v = small([str(i) for i in range(20)], (0, 4, 8, 9, 15, 21), 2)
    parts = scoring.unpack(scoring.first_parameters(v), v)
    squares = [np.full_like(p, 1e-3) for p in parts]
    context = rng.integers(0, 22, (400, 4))
    losses = [scoring.descend(parts, squares, v.first, context, scoring.outcome(v, context[:, 1]), 0.1) for _ in range(150)]
    assert losses[-1] < 0.5 * losses[0]


def test_gradients_are_those_of_the_loss():
    """Against differences, in double precision: the first step of each number goes down its own slope."""
    rng = np.random.default_rng(1)
    v = small([str(i) for i in range(7)], (0, 3, 4, 8), 2)
    flat = scoring.first_parameters(v, 5).astype(float)
    flat += rng.standard_normal(len(flat)) * 0.3
    context, target = rng.integers(0, 9, (30, 4)), rng.integers(0, 8, 30)
    loss = lambda f: -scoring.log_probabilities(scoring.unpack(f, v), v.first, context, target).mean()
    moved = flat.copy()
    squares = [np.ones_like(p) for p in scoring.unpack(flat, v)]
    assert abs(scoring.descend(scoring.unpack(moved, v), squares, v.first, context, target, 1e-6) - loss(flat)) < 1e-9
    for i in rng.choice(len(flat), 120, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert abs((flat[i] - moved[i]) / 1e-6 - slope / math.sqrt(1 + slope * slope)) < 1e-4


def test_word_counts(spark):
    rows = [(1, "a B a"), (2, "b\ta"), (3, None)]
    got = {bytes(r.word): r.n for r in scoring.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), most_held=1).collect()}
    assert got == {b"a": 3, b"b": 2}
    assert scoring.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_position_is_a_target(spark):
    """One text of 40 different words: each word's position is descended on in a single round."""
    words = [f"w{i}" for i in range(40)]
    v = small(words, range(42), 1)
    text = v.ids(" ".join(words).encode())[0].astype("<u2").tobytes()
    ids = spark.createDataFrame([(1, text, 5)], "doc_id long, ids binary, h1 long").coalesce(1)
    start = scoring.first_parameters(v)
    before = scoring.unpack(start, v)[4]
    after = scoring.unpack(scoring.train(ids, v, rounds=1), v)[4]
    # A class that is never a target only loses bias.
    assert (after[:40] > before[:40]).all() and (after[40:] < before[40:]).all()


def test_partitions_and_copies_change_nothing(spark):
    rows = corpus()[:80]
    rows += [(1000 + i, t) for i, t in rows[:30]] + [(2007, None), (2008, "zq " * 50), (2009, "the same gibberish xkcdqq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [{(r.doc_id, r.n_tokens): r.pseudo_log_likelihood for r in scoring.score_documents(df.repartition(n), words=30).collect()} for n in (1, 7)]
    assert runs[0] == runs[1]
    by = {d: s for (d, _), s in runs[0].items()}
    assert all(by[1000 + i] == by[i] for i, _ in rows[:30])


def test_rare_words_are_spelt(spark):
    """A string that looks like no other word of the corpus is less likely than a rare word that does."""
    rows = [(i, " ".join(f"plain{j}" for j in range(i, i + 40))) for i in range(60)] + [(900, "plain7x plain8"), (901, "q#~Zz@! plain8")]
    by = {r.doc_id: r.pseudo_log_likelihood for r in scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=20).collect()}
    assert by[900] > by[901] + 5


def test_bounds_of_the_vocabulary(spark):
    import pytest

    with pytest.raises(ValueError, match="16 bits"):
        scoring.build_vocabulary(spark.createDataFrame([(1, "a")], "doc_id long, text string"), words=65_000)


def test_single_precision_exponentials():
    """Close to those in double precision, and the same whatever is worked out together."""
    rng = np.random.default_rng(6)
    v = small([str(i) for i in range(20)], (0, 4, 8, 9, 15, 21), 2)
    flat = scoring.first_parameters(v, 5).astype(float) + rng.standard_normal(scoring.first_parameters(v).size)
    parts, docs = scoring.unpack(flat, v), [rng.integers(0, 22, n) for n in (700, 0, 1, 350)]
    for scale in (1, 200):  # also where sums are too large for an exponential
        parts[5][:] *= scale
        exact = scoring.score_texts(parts, v, docs)
        fast = [scoring.score_texts(parts, v, docs, most, np.float32) for most in (7, 500, 16384)]
        assert np.isfinite(exact).all() and all(np.abs(f - exact).max() < 3e-6 * 700 for f in fast)
        assert np.abs(fast[0] - fast[1]).max() < 1e-8 and np.abs(fast[0] - fast[2]).max() < 1e-8


def test_blocks_add_up_in_two_levels(spark):
    rng = np.random.default_rng(7)
    sums = rng.integers(-(1 << 50), 1 << 50, (11, 3 * scoring.BLOCK))
    import pyarrow as pa

    rows = pa.Table.from_batches([scoring.sent_blocks(s, i % 3) for i, s in enumerate(sums)])
    df = spark.createDataFrame(rows).repartition(5)
    for keys in (["root", "block"], ["block"]):
        df = df.groupBy(*keys).applyInArrow(scoring.block_sum, scoring.BLOCKS)
    got = {r.block: np.frombuffer(r.x, "<i8") for r in df.collect()}
    assert (np.concatenate([got[i] for i in range(3)]) == sums.sum(0)).all()


def test_several_learners_are_averaged(spark):
    """The parameters after a part are the mean of those that each learner reaches alone from the same start."""
    rng = np.random.default_rng(9)
    v = small([str(i) for i in range(20)], (0, 4, 8, 9, 15, 21), 2)
    rows = [(i, rng.integers(0, 22, 40).astype("<u2").tobytes(), i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary, h1 long")
    got = scoring.train(df, v, parts_per_round=1, learner=300)
    placed = df.selectExpr("pmod(xxhash64(h1, doc_id), 8) as learner", "xxhash64(doc_id, h1) as at", "ids").orderBy("learner", "at").collect()
    ends = []
    for k in range(8):
        flat = scoring.first_parameters(v)
        parts = scoring.unpack(flat, v)
        context, target = scoring.windows([np.frombuffer(r.ids, "<u2") for r in placed if r.learner == k], v.outside)
        if len(target):
            scoring.descend(parts, [np.full_like(p, 1e-3) for p in parts], v.first, context, scoring.outcome(v, target), 0.1)
            ends.append(flat)
    assert len(ends) > 4 and np.abs(got - np.mean(ends, axis=0)).max() < 1e-6


def test_columns_of_texts_against_a_plain_loop(spark):
    """Counting and encoding take whole columns; words outside the vocabulary are a class of their own, so no sum over rare words is worked out for them."""
    import zlib

    import pyarrow as pa

    said = ["a B\x0bb \x1cq q", "", None, " \t", "B", "  zz a\r\nÄa "]
    v = small(["a", "b"], (0, 1, 3))._replace(spelling=np.random.default_rng(3).standard_normal((256, 256)))
    plain = []
    for t in said:
        words = (t or "").encode().lower().split()
        rare = [w for w in words if w not in v.words]
        spelt = sum(v.spelling[x, y] for w in rare for x, y in zip(b" " + w, w + b" ", strict=True))
        plain.append(([v.words.get(w, 2 + zlib.crc32(w) % 3) for w in words], spelt))
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        values = [t and t.encode() for t in said] if kind == pa.binary() else said
        for column, want in ((pa.array(values, kind), plain), (pa.array(values * 2, kind).slice(4, 5), (plain * 2)[4:9])):
            ids, spelt = v.encoded(column, pa.array(list(v.words), pa.binary()))
            assert [x.tolist() for x in ids] == [i for i, _ in want] and np.allclose(spelt, [s for _, s in want])
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*said, "a a a b b c d e f g"])], "doc_id long, text string")
    made = scoring.build_vocabulary(df, words=6, classes=3)
    assert made.first[-2:].tolist() == [len(made.words), len(made.words) + 1]

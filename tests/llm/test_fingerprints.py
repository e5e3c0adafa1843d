import hashlib

import numpy as np
from pyspark.sql import functions as F

from docmill.llm import fingerprints as fp


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def true_likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 2
        edited = text[: len(text) - k] + nxt[:k]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), true_likeness(text, edited), true_likeness(text, nxt)))
    return out


def test_against_exact_sets(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}é" for i in range(500)]
    rows = [(i * 3, " ".join(rng.choice(words, int(rng.integers(30, 400))))) for i in range(200)]
    rows += [(1, rows[0][1]), (4, None), (5, ""), (7, "one"), (10, " \n"), (13, "a b c"), (None, "first of all"), (700, "x " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'f' as fingerprint", "3 as part", "true as tail")
    got = fp.fingerprint_edits(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    wrong = []
    for doc, n, sha, edited, nxt in expected(rows):
        r = by[doc]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        wrong += [r.near_edited - edited, r.near_next - nxt]
    assert np.abs(wrong).max() < 0.15 and np.abs(np.mean(wrong)) < 0.01
    assert by[0].fingerprint == by[1].fingerprint != by[3].fingerprint
    assert by[5].fingerprint == fp.EMPTY == by[10].fingerprint


def test_repeated_rows_and_single_rows(spark):
    got = fp.fingerprint_edits(spark.createDataFrame([(9, "a b"), (9, "a b"), (9, "a c")], "doc_id long, text string")).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(s for _, _, s, _, _ in expected([(9, "a b"), (9, "a b"), (9, "a c")]))
    one = fp.fingerprint_edits(spark.createDataFrame([(2, "abc def")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()
    assert fp.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_ids_and_copies_are_dealt_out(spark):
    """Many rows under one doc_id, a third of them equal: no part is much larger than others, and every row has its result."""
    rows = [(None, f"text number {i} of many {i * i}") for i in range(1500)] + [(None, "the same text again")] * 1500 + [(i, f"own {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = fp.with_next(df, rows_per_part=100).where("not tail").groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 300
    assert fp.with_next(df, rows_per_part=100).where("tail").groupBy("part").count().where("count > 1").count() == 0
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    want = []
    for i, (doc, text) in enumerate(order):
        k = len(text) // 2
        want.append((-1 if doc is None else doc, hashlib.sha256((text[: len(text) - k] + order[(i + 1) % len(order)][1][:k]).encode()).hexdigest()))
    got = fp.fingerprint_edits(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.edited_sha256) for r in got) == sorted(want)
    assert fp.with_next(df, rows_per_part=100).where("not tail").select(F.sum("n")).first()[0] == len(rows)


def test_words_are_hashed_by_their_bytes():
    texts = [b"Some words, some WORDS", b"", b"words\tsome\x0bx", b"x" * 300]
    hashes, counts = fp.word_hashes(texts)
    assert counts.tolist() == [4, 0, 3, 1]
    some, words, again, caps, w2, s2, x, _ = hashes.tolist()
    assert some == again == s2 and caps == w2 != words and len({some, words, caps, x}) == 4


def test_every_bin_is_filled():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 300):
        minima = np.full(fp.BINS, (1 << 64) - 1, np.uint64)
        at = rng.choice(fp.BINS, n, replace=False)
        minima[at] = np.arange(n, dtype=np.uint64)
        out = fp.densify(minima, minima != np.uint64((1 << 64) - 1))
        assert out.max() < n and (out[at] == np.arange(n)).all()

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import langid

SMALL = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["ka", "ru", "mo", "ti"], "bb": ["schl", "ung", "ein", "ber"], "cc": ["eau", "oi", "que", "é"]}


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        lang = ("aa", "bb", "cc")[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(int(rng.integers(5, 40))))
        rows.append((i, text, lang if i % 7 else None))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 ?!", "cc"), (1003, "\n", None), (None, "karumo tikaru mokati", "aa"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as lang_pred", "1 as score", "1 as drawn"), rows


def test_learns_and_predicts(made):
    df, rows = made
    out = langid.identify(df, langid.train(df, ~langid.held_out())).collect()
    assert len(out) == len(rows)
    truth = {r[0]: ("aa", "bb", "cc")[r[0] % 3] for r in rows if r[0] is not None and r[0] < 1000}
    assert all(r.lang_pred == truth[r.doc_id] and 0.3 < r.score <= 1 for r in out if r.doc_id in truth)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if (r.doc_id or 0) >= 1000)


def test_held_out_rows_do_not_teach(made):
    df, _ = made
    plain = langid.train(df, ~langid.held_out())
    other = langid.train(df.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang"))), ~langid.held_out())
    assert other.languages == plain.languages and np.array_equal(other.weights, plain.weights) and np.array_equal(other.idf, plain.idf)
    assert (plain.weights == 0).mean() > 0.5  # sparse
    flags = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, h in flags.items())


def test_bucket_frequencies_against_a_count(made):
    df, rows = made
    want = np.zeros((1 << langid.BITS) + 1, int)
    for _, text, _ in rows:
        want[langid.gram_counts(text or "")[0]] += 1
        want[-1] += 1
    assert np.array_equal(langid.bucket_frequencies(df), want)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = langid.identify(docs, langid.train(docs, ~langid.held_out())).join(docs, "doc_id").where(langid.held_out())
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.9 * total > 0


def test_copies_of_one_row_are_drawn_once(spark):
    hot = spark.range(20000).selectExpr("case when id < 15000 then 7 else id end as doc_id", "case when id < 15000 then 'the same text' else concat('text ', id) end as text", "'aa' as lang")
    rows = langid.sample_features(hot, np.ones((1 << langid.BITS)), 100)
    assert len({r[1] for r in rows}) == len(rows) and 50 < len(rows) < 200


def plain_ftrl(rows, languages, size, epochs, alpha, beta, l1, l2):
    """One weight at a time, by the update's definition."""
    z, n = ([[0.0] * len(languages) for _ in range(size + 1)] for _ in range(2))

    def weight(i, c):
        a, b = (0.0, 0.0) if i == size else (l1, l2)
        return 0.0 if abs(z[i][c]) <= a else -(z[i][c] - math.copysign(a, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + b)

    for _ in range(epochs):
        for lang, _, at, x in rows:
            pairs = [*zip(at, x, strict=True), (size, 1.0)]
            w = {i: [weight(i, c) for c in range(len(languages))] for i, _ in pairs}
            s = [sum(v * w[i][c] for i, v in pairs) for c in range(len(languages))]
            e = [math.exp(v - max(s)) for v in s]
            for i, v in pairs:
                for c, name in enumerate(languages):
                    g = v * (e[c] / sum(e) - (name == lang))
                    z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha * w[i][c]
                    n[i][c] += g * g
    return [[weight(i, c) for c in range(len(languages))] for i in range(size + 1)]


def made_rows(seed, n):
    rng = np.random.default_rng(seed)
    return [(("aa", "bb", "cc")[int(rng.integers(3))], i, np.sort(rng.choice(20, int(rng.integers(1, 6)), replace=False)), rng.random(1)[0] * np.ones(1)) for i in range(n)]


def test_training_against_a_plain_loop():
    rows = [(lang, i, at, np.resize(x, len(at))) for lang, i, at, x in made_rows(1, 60)]
    for l1 in (0.02, 1.0):
        weights, bias = langid.train_ftrl(rows, ["aa", "bb", "cc"], 20, 3, l1=l1)
        want = np.array(plain_ftrl(rows, ["aa", "bb", "cc"], 20, 3, 0.5, 1.0, l1, 0.02))
        np.testing.assert_allclose(np.vstack([weights, bias]), want, atol=1e-10)
    assert (want[:20] == 0).any() and not (want[20] == 0).any()


def test_temperature_against_a_grid():
    rows = [(lang, i, at, np.resize(x, len(at))) for lang, i, at, x in made_rows(2, 80)]
    rng = np.random.default_rng(3)
    weights, bias = rng.normal(size=(20, 3)) * 3, rng.normal(size=3)

    def loss(t):
        total = 0.0
        for lang, _, at, x in rows:
            s = (x @ weights[at] + bias) / t
            total += math.log(sum(math.exp(v) for v in s)) - s[["aa", "bb", "cc"].index(lang)]
        return total

    best = min((math.exp(k / 200) for k in range(-600, 601)), key=loss)
    assert langid.calibrate(rows, ["aa", "bb", "cc"], weights, bias) == pytest.approx(best, rel=0.01)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.train(empty, ~langid.held_out())
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_without_a_learnt_language_every_text_with_letters_stays(spark):
    rows = [(1, "the window", None), (2, "über", None), (3, "123 --", None), (4, "", None), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, ~langid.held_out())
    assert model.languages == []
    assert {r.doc_id for r in langid.reject_unknown(df, model).collect()} == {1, 2}


def test_the_bound_follows_the_number_of_languages(spark):
    """Of ten languages one has a quarter of the probability; the others share the rest."""
    bias = np.append(np.log(0.25), np.full(9, np.log(0.75 / 9)))
    model = langid.Model([f"l{i}" for i in range(10)], np.ones(64), np.zeros((64, 10)), bias, 1.0)
    even = model._replace(bias=np.zeros(10))
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert langid.reject_unknown(df, model).count() == 1
    assert langid.reject_unknown(df, even).count() == 0

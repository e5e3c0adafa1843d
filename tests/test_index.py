"""The stored index: against the operators that read texts, through upserts, crashes and compaction; and the index of vectors."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import index, maintain, search, vectors
from docmill.plans import pipelines
from docmill.plans.suites import pipelines as suite

SF = "/root/testdata/sf0.001"
SCHEMA = "chunk_uuid string, content string, filename string, ingestion_ts timestamp"


def rows(n, seed, first=0):
    rng = random.Random(seed)
    word = lambda: rng.choice(["MFA", "mfa", "émfa", "Risk", "risks", "x1", "İo", "the", "a", "plan-b", "règle", "MFA_x"])
    out = [(f"c{i}", rng.choice([None, "", " - ", *[rng.choice([" ", ", ", "  "]).join(word() for _ in range(rng.randrange(1, 40))) for _ in range(6)]]), rng.choice(["gloss.md", "other.md"])) for i in range(first, first + n)]
    return [(*r, None) for r in out]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("ingestion_ts", F.to_timestamp(F.lit("2024-01-01")) + F.expr("make_interval(0,0,0,0,0, cast(substring(chunk_uuid, 2) as int))"))


def standing(phrase, text):
    """Whether a text contains a phrase so that the phrase's longest word stands whole."""
    found = re.findall(r"[^\W_]+", phrase)
    if not found:
        return False
    longest = min(found, key=lambda w: (-len(w), w))
    at = re.search(rf"(?<![^\W_]){re.escape(longest)}(?![^\W_])", phrase).start()
    free = r"(?<![^\W_])", r"(?![^\W_])"
    return bool(re.search(re.escape(phrase[:at]) + free[0] + re.escape(longest) + free[1] + re.escape(phrase[at + len(longest) :]), text))


def channels(idx, chunks, spark):
    """Each channel from the index and from the texts."""
    phrases = spark.createDataFrame([(1, "risk, the"), (1, "isks the"), (2, "plan-b"), (3, "a  mf"), (4, " - "), (5, "MFA risk"), (6, "")], "query_id int, phrase string")
    aliases = spark.createDataFrame([(1, "MFA"), (1, "isk"), (2, "plan-b a"), (3, "X1"), (4, "ègle"), (4, "the  a")], "query_id int, alias string")
    terms = spark.createDataFrame([(1, ["mfa", "the"]), (2, ["zebra"]), (3, ["b", "x1", "règle"])], "query_id int, terms array<string>")
    of = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    met = {(q, r.chunk_uuid, r.ingestion_ts) for q, p in phrases.collect() for r in chunks.collect() if p and standing(p.lower(), (r.content or "").lower())}
    ranked = [(q, c, n + 1) for q in {q for q, _, _ in met} for n, (_, c) in enumerate(sorted(((t, c) for i, c, t in met if i == q), key=lambda x: (-x[0].timestamp(), x[1]))[:7])]
    return [
        (of(index.phrase_search(phrases, idx, 7), "query_id", "chunk_uuid", "rank"), sorted(ranked)),
        (of(index.glossary_search(aliases, idx, k=3), "query_id", "alias", "chunk_uuid", "rank"), of(search.glossary_topk(aliases, chunks, k=3), "query_id", "alias", "chunk_uuid", "rank")),
        (of(index.text_search(terms, idx, 9, digits=6), "query_id", "chunk_uuid", "score"), of(search.text_topk(terms, search.inverted_index(chunks), 9, digits=6), "query_id", "chunk_uuid", "score")),
        (of(index.text_search(terms, idx, 9, "bm25", 6), "query_id", "chunk_uuid", "score"), of(search.text_topk(terms, search.inverted_index(chunks), 9, "bm25", n_chunks=search.corpus_size(chunks)[0], mean_length=search.corpus_size(chunks)[1], digits=6), "query_id", "chunk_uuid", "score")),
    ]


def test_channels_agree_with_texts_through_upserts_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FEW_BUCKETS", 1)
    monkeypatch.setattr(index, "BUCKET_CHARS", 2000)
    data = spark.createDataFrame(frame(spark, rows(120, 1)).collect(), SCHEMA)
    idx = index.build_index(data, str(tmp_path / "i"))
    assert idx.buckets > 1
    for mine, texts in channels(idx, data, spark):
        assert mine == texts and mine
    more = spark.createDataFrame(frame(spark, rows(60, 2, 80)).collect(), SCHEMA)
    now = maintain.upsert_chunks(data, more)
    idx = index.upsert(idx, more)
    assert idx.segments == (0, 1)
    for one in (idx, index.compact(idx, str(tmp_path / "j"))):
        for mine, texts in channels(one, now, spark):
            assert mine == texts
        assert sorted(r.chunk_uuid for r in index.current_texts(one).collect()) == sorted(r.chunk_uuid for r in now.collect())


def test_a_segment_counts_only_when_it_is_complete(spark, tmp_path):
    path = str(tmp_path / "i")
    idx = index.build_index(frame(spark, rows(20, 3)), path)
    index.posting_rows(frame(spark, rows(5, 4)), idx.buckets).write.partitionBy("bucket").parquet(f"{path}/postings/segment=1")  # a crash before the manifest
    assert index.open_index(spark, path).segments == (0,)
    assert index.upsert(index.open_index(spark, path), frame(spark, rows(5, 5))).segments == (0, 1)


def test_an_empty_index(spark):
    idx = index.build_index(frame(spark, rows(0, 1)))
    q = spark.createDataFrame([(1, "a b")], "query_id int, phrase string")
    assert index.phrase_search(q, idx).count() == index.corpus_size(idx)[0] == 0
    assert index.text_search(spark.createDataFrame([(1, ["a"])], "query_id int, terms array<string>"), idx).count() == 0


def test_no_text_is_read_before_the_chosen_sources(spark, monkeypatch):
    read = []
    real = pipelines.stored
    monkeypatch.setattr(pipelines, "stored", lambda df, path: (read.append(df.inputFiles()), real(df, path))[1])
    out = suite.c3_all(spark, SF)
    assert len(read) > 5 and not any("/texts/" in f for files in read for f in files)
    assert any("/texts/" in f for f in out["sources"].inputFiles())


def test_relations_are_placed_and_narrowed(spark):
    from docmill.operators import graph

    found = spark.createDataFrame([(1, "a", "OWNS", "b", 1), (1, "b", "USES", "c", 2), (1, "c", "IS", "d", 3), (2, "a", "OWNS", "b", 1)], "query_id int, source string, relation string, target string, rank int")
    mentions = spark.createDataFrame([("a", "k1"), ("a", "k0"), ("c", "k2"), ("d", "k9")], "entity_id string, chunk_uuid string")
    chunks = spark.createDataFrame([("k0", "y.md", 2, 1), ("k1", "x.md", 7, 0), ("k2", "y.md", 1, 0)], "chunk_uuid string, filename string, page_no int, chunk_index int")
    placed = graph.place_relations(found, mentions, chunks)
    assert {(r.source, r.target): (r.filename, r.page) for r in placed.collect()} == {("a", "b"): ("x.md", 7), ("b", "c"): ("y.md", 1), ("c", "d"): ("y.md", 1)}
    asked = spark.createDataFrame([(1, ["uses", "zz"], ["is", "y.md"], ""), (2, ["owns"], [], "y")], "query_id int, concepts array<string>, tokens array<string>, document string")
    got = graph.narrow_relations(placed, asked, 2).collect()
    assert [(r.query_id, r.source, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(1, "b", 1), (1, "c", 2)]  # question 2's document has no such row


def test_recall_of_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    v = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16))
    data = spark.createDataFrame([(f"c{i:04d}", x.tolist()) for i, x in enumerate(v)], "chunk_uuid string, embedding array<double>")
    made = vectors.build_index(data, 16)
    assert made.arrays.select(F.sum(F.size("vs"))).first()[0] == 2000
    q = data.where("chunk_uuid like '%7'").select(F.col("chunk_uuid").alias("query_id"), "embedding")
    probes = vectors.probes_for(made, 10)
    assert probes < 16 and vectors.recall(made, q, 10, probes) >= 0.9
    assert vectors.recall(made, q, 10, 16) == pytest.approx(1.0)


def test_cells_of_nothing(spark):
    data = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None)], "chunk_uuid string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<double>")
    assert vectors.search(vectors.build_index(data), q).count() == 0

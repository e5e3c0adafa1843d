"""Snapshot tables and the streamed ingestion: replays, crashes, compaction, and equality with the batch job."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import extract
from docmill.plans import pipelines
from docmill.sources.shared import remove_folder
from docmill.streaming import ingest, snapshots


def batches(seed, n=5):
    rng = random.Random(seed)
    return [[(rng.randrange(40), rng.randrange(9) * 100 + i, f"b{b}r{i}") for i in range(rng.randrange(0, 25))] for b in range(n)]


def state(spark, table):
    return sorted(tuple(r) for r in snapshots.read_table(spark, table, "k", "at").collect())


@pytest.mark.parametrize("after", [1, 3, 100])
def test_the_last_row_of_each_key(spark, tmp_path, after):
    table, want = str(tmp_path / "t"), {}
    for b, rows in enumerate(batches(after)):
        for k, at, v in sorted(rows, key=lambda r: r[1]):
            if k not in want or at >= want[k][0]:
                want[k] = (at, v)
        df = spark.createDataFrame(rows, "k int, at int, v string")
        now = snapshots.put(df, b, table, "k", "at", after)
        assert snapshots.put(spark.createDataFrame([(1, 9999, "again")], "k int, at int, v string"), b, table, "k", "at", after) == now  # a batch that is in changes nothing
        assert state(spark, table) == sorted((k, at, v) for k, (at, v) in want.items())
        assert len(now.deltas) < after


def test_a_crash_between_write_and_commit(spark, tmp_path):
    table = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), "k int, at int, v string")
    snapshots.put(df((1, 1, "a"), (2, 1, "b")), 0, table, "k", "at")
    before = state(spark, table)
    df((1, 5, "half"), (9, 9, "half")).withColumn("batch", F.lit(1).cast("long")).write.parquet(f"{table}/batch-1")  # and then the driver died
    assert state(spark, table) == before
    snapshots.put(df((1, 2, "c")), 1, table, "k", "at")
    assert state(spark, table) == [(1, 2, "c"), (2, 1, "b")]


def test_folders_are_deleted_after_compaction(spark, tmp_path):
    table = str(tmp_path / "t")
    for b in range(9):
        snapshots.put(spark.createDataFrame([(b % 4, b, "v")], "k int, at int, v string"), b, table, "k", "at", 2)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name != "manifest"]) <= 6
    assert len(list((tmp_path / "t" / "manifest").iterdir())) == 1
    assert state(spark, table) == [(0, 8, "v"), (1, 5, "v"), (2, 6, "v"), (3, 7, "v")]


def test_the_stream_gives_the_rows_of_the_batch_job(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.randrange(1, 400)))
    rows = [(i if i % 5 else None, rng.choice([f"f{i}.txt", f"f{i}.md", None]), rng.choice(["TIER_A_NORMATIVE/x", "TIER_C_EVIDENCES/logs/y", None]), rng.choice([text(), text(), None])) for i in range(24)]
    files = spark.createDataFrame(rows, "doc_id long, filename string, path string, text string").selectExpr("*", "date'2024-01-01' as ingest_date", "timestamp'2024-01-01' as ingestion_ts")
    files.repartition(4).write.parquet(str(tmp_path / "inbox"))
    sidecars = spark.createDataFrame([(1, "C", "own")], "doc_id long, tier string, ontology string").selectExpr("*", "cast(null as string) content_type", "cast(null as string) source_kind", "cast(null as date) effective_date")
    args = [str(tmp_path / n) for n in ("inbox", "table", "status", "ck")]
    ingest.drain(ingest.stream_corpus(spark, *args, extract.taxonomy(spark), sidecars, files_per_trigger=1))
    ingest.drain(ingest.stream_corpus(spark, *args, extract.taxonomy(spark), sidecars, files_per_trigger=1))  # nothing new
    table, status = pipelines.ingest_corpus(files, extract.taxonomy(spark), sidecars=sidecars)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    streamed = snapshots.read_table(spark, args[1], "chunk_uuid", "ingestion_ts")
    assert key(streamed.select(*table.columns)) == key(table) and table.count() > 10
    assert key(spark.read.parquet(args[2]).select(*status.columns)) == key(status)
    remove_folder(spark, args[1])

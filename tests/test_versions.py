"""W-1 from buckets: the rows of latest_versions, without a shuffle or a sort of texts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import search
from docmill.sources import files
from docmill.sources.shared import new_folder


@pytest.fixture(scope="module")
def versions(spark):
    rng = random.Random(5)
    day = lambda: rng.choice([None, *[datetime.datetime(2024, 1, d) for d in (1, 2, 3)]])
    rows = [(rng.choice([None, *[f"c{i}" for i in range(60)]]), day(), rng.choice([None, "", "x", "y" * 5000, "z"]), rng.choice(["A", None])) for _ in range(400)]
    hot = [("hot", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), f"text {i}", "B") for i in range(300)]
    df = spark.createDataFrame(rows + rows[:50] + hot, "chunk_uuid string, ingestion_ts timestamp, content string, tier string")
    path = new_folder(spark, "versions")
    return df, files.write_bucketed(df, "versions_written", path, 8), path


def found(df):
    return sorted(((r.chunk_uuid, r.ingestion_ts, r.content) for r in df.collect()), key=repr)


def test_rows_are_those_of_the_window(spark, versions):
    df, table, path = versions
    want = found(search.latest_versions(df))
    assert found(search.latest_bucketed(table)) == want and len(want) == df.select("chunk_uuid").distinct().count()
    assert search.latest_bucketed(table).columns == df.columns
    assert found(search.latest_bucketed(files.open_bucketed(spark, "versions_opened", path, 8))) == want


def test_keys_choose_chunks(spark, versions):
    df, table, _ = versions
    keys = spark.createDataFrame([("c1",), ("c1",), ("hot",), ("absent",)], "chunk_uuid string")
    assert found(search.latest_bucketed(table, keys)) == found(search.latest_versions(df, keys))


def test_an_empty_table(spark, versions):
    empty = files.write_bucketed(versions[0].limit(0), "versions_empty", new_folder(spark, "versions"), 4)
    assert search.latest_bucketed(empty).count() == 0


def test_no_text_is_shuffled_or_sorted(spark, versions):
    plan = search.latest_bucketed(versions[1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    for line in plan.splitlines():
        if "Sort [" in line:
            assert "content#" not in line
    picks = plan.split("TakeOrdered")[0]  # what follows is the one row without an id
    scans = [line for line in picks.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("content:string" in line for line in scans) == 1
    assert picks.count("Sort [") == 1 and "SortMergeJoin" not in plan


def test_opened_tables_need_no_shuffle_either(spark, versions):
    t = files.open_bucketed(spark, "versions_again", versions[2], 8)
    assert "Exchange" not in search.latest_bucketed(t).where(F.col("tier") == "A")._jdf.queryExecution().executedPlan().toString()

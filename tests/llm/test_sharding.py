import zlib
from collections import defaultdict

import numpy as np
import pytest

from docmill.llm import sharding


def brute(hashes, rows, shards, law):
    """Shard and slot of each row from one sort of all of them."""
    order = sorted(range(len(rows)), key=lambda i: (hashes[i], rows[i][0] if rows[i][0] is not None else -(1 << 63)))
    size = [len((t or "").encode()) + 1 for _, t in rows]
    total, at, out, used = sum(size), 0, defaultdict(int), defaultdict(int)
    for place, i in enumerate(order):
        shard = min(shards - 1, (2 * at + size[i]) * shards // (2 * total)) if law == "bytes" else place * shards // len(rows)
        out[rows[i][0], size[i], zlib.crc32((rows[i][1] or "").encode()), shard, used[shard]] += 1
        used[shard] += 1
        at += size[i]
    return out


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_against_one_sort(spark, law):
    rng = np.random.default_rng(1)
    rows = [(i, "wörd " * int(rng.integers(0, 60)) + str(i)) for i in range(300)]
    rows += [(1000 + i, "copy of a long text " * 3) for i in range(250)]  # a hot group
    rows += [(5000, None), (5001, ""), (None, "no id"), (5002, "x" * 30000), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "9 as size", "1 as shard")
    hashes = [r.h for r in df.selectExpr("xxhash64(coalesce(text, '')) h").collect()]
    got = defaultdict(int)
    for r in sharding.assign_shards(df, 16, law).collect():
        got[r.doc_id, r.size, r.text_crc32, r.shard, r.slot] += 1
        assert r.law == law
    assert got == brute(hashes, rows, 16, law)
    for s in range(16):
        slots = sorted(k[4] for k in got for _ in range(got[k]) if k[3] == s)
        assert slots == list(range(len(slots)))


def test_result_does_not_depend_on_the_draw(spark):
    df = spark.range(400).selectExpr("id as doc_id", "repeat('a', cast(id % 37 as int)) as text")
    one = {tuple(r) for r in sharding.assign_shards(df, 5).collect()}
    assert one == {tuple(r) for r in sharding.assign_shards(df, 5, oversample=1, rounds=0).collect()}


def test_empty_and_few(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(df).count() == 0
    assert sharding.assign_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1


def test_binary_search(spark):
    splitters = [(-5, 1), (0, 0), (0, 7), (9, -(1 << 63)), (9, 3)]
    rows = [(k, i) for k in (-9, -5, 0, 3, 9, 10) for i in (-(1 << 63), 0, 1, 3, 7, 8)]
    df = spark.createDataFrame(rows, "key long, id long")
    for r in df.withColumn("n", sharding.range_number(splitters)).collect():
        assert r.n == sum(s <= (r.key, r.id) for s in splitters)

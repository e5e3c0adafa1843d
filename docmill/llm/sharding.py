"""Sharding of documents by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import materialize

LEAST_RANGES, MOST_RANGES = 1024, 16384
NO_ID = -(1 << 63)


def _longs(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_number(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters (key, id) are at or below a row's (key, id), by binary search."""
    if not splitters:
        return F.lit(0)
    keys, ids, n = _longs([s[0] for s in splitters]), _longs([s[1] for s in splitters]), len(splitters)

    def go(place: Column, step: Column) -> Column:
        at = place + step
        key = F.element_at(keys, F.least(at, F.lit(n)))
        below = (key < F.col("key")) | (key == F.col("key")) & (F.element_at(ids, F.least(at, F.lit(n))) <= F.col("id"))
        return F.when((at <= n) & below, at).otherwise(place)

    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), go)


def quantiles(sample: list[tuple[int, int]], pieces: int) -> list[tuple[int, int]]:
    """Up to pieces - 1 boundaries that divide a sample evenly."""
    ordered = sorted(sample)
    return sorted({ordered[len(ordered) * i // pieces] for i in range(1, pieces)}) if ordered else []


def assign_shards(docs: DataFrame, shards: int = 16, law: str = "bytes", rows_per_range: int = 50_000, oversample: int = 4, rounds: int = 3) -> DataFrame:
    """Puts each row of docs (doc_id, text) in a shard.

    Records are ordered by (xxhash64 of the text, doc_id), so that equal texts lie together,
    and each shard takes a run of that order. law `bytes`: a record goes to the shard in which
    the middle of its bytes falls, so a shard's size differs from an equal share by at most
    the largest record. law `rows`: runs of equal counts, at most one apart.

    Returns doc_id long, size long (UTF-8 bytes of the text plus 1), text_crc32 long, law
    string, shard int, slot long (place in the shard, gapless from 0).

    Method: keys are drawn with a chance in proportion to size, quantiles of the draw are the
    splitters, and splitters range-partition the records. Ranges with over twice their share
    of bytes are drawn from again and subdivided, as a group of copies with a large share is:
    a splitter is a (key, doc_id), so it can cut inside a group. Each range is then sorted by
    itself, and offsets from sums over the ranges make its places global. The result does not
    depend on the draw; only the evenness of the tasks does.

    Edge cases: a null text has size 1 and the order of an empty one; a null doc_id sorts
    before others; repeated rows get slots of their own; an empty table gives an empty result;
    with fewer records than shards some shards are empty.

    Scale: texts are read once and reduced to 40 bytes a record. The driver sees at most
    oversample draws for each of at most 16,384 ranges, the only thing broadcast is a row for
    each range, and a range grows only when records outnumber that many ranges.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
            "doc_id",
            F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
            (F.octet_length("t") + 1).cast("long").alias("size"),
            F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
            F.xxhash64("t").alias("key"),
        ),
        "shard-keys",
    )
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(rows / rows_per_range)))
    drawn = F.pmod(F.xxhash64(F.lit("draw"), "key", "id"), F.lit(1 << 40)) / float(1 << 40)

    def draw(df: DataFrame, rate: float) -> list[tuple[int, int]]:
        """(key, id) of rows drawn with a chance of rate for each byte."""
        return [(r.key, r.id) for r in df.where(drawn < F.col("size") * rate).select("key", "id").collect()]

    splitters = quantiles(draw(keys, ranges * oversample / max(total, 1)), ranges)
    share = max(total / ranges, 1)
    for _ in range(rounds):
        placed = keys.withColumn("range", range_number(splitters))
        full = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > 2 * share) & (F.col("n") > 1)).collect()
        if not full:
            break
        inside = placed.where(F.array_contains(_longs([r["range"] for r in full]), F.col("range").cast("long")))
        more = draw(inside, oversample / share)
        pieces = math.ceil(sum(r.bytes for r in full) / share)
        added = set(splitters) | set(quantiles(more, pieces))
        if added == set(splitters):
            break
        splitters = sorted(added)
    placed = keys.withColumn("range", range_number(splitters))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    own = Window.partitionBy("range").orderBy("key", "id", "size")
    through = own.rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(through)) - F.col("size")  # twice the middle of the record
    place = F.col("rows_before") + F.row_number().over(own) - 1
    ordered = placed.join(F.broadcast(offsets), "range").withColumn("middle", middle).withColumn("place", place)
    if law == "bytes":
        shard = F.least(F.expr(f"middle * {shards} div {max(2 * total, 1)}"), F.lit(shards - 1))
    else:
        shard = F.expr(f"place * {shards} div {max(rows, 1)}")
    ordered = materialize(ordered.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "place"), "shard-places")
    first = ordered.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return ordered.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"))

"""A table of the last row of each key, kept as snapshots: a base, the batches since, and a manifest that names both."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.maintain import last_by_key
from docmill.sources.shared import remove_folder


class Snapshot(NamedTuple):
    """The last batch that is in, the folder of the base (or none yet), the folders of the batches since, and those that the last compaction replaced."""

    batch: int
    base: str | None
    deltas: list[str]
    old: list[str]


MANIFEST = "batch long, base string, deltas array<string>, old array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def snapshot(spark: SparkSession, table: str) -> Snapshot | None:
    """The newest snapshot: that of the manifest with the highest batch. There are two manifests at most between batches."""
    if not exists(spark, f"{table}/manifest"):
        return None
    rows = [Snapshot(r.batch, r.base, list(r.deltas or []), list(r.old or [])) for r in spark.read.schema(MANIFEST).json(f"{table}/manifest/*").collect() if r.batch is not None]
    return max(rows) if rows else None


def _resolved(now: Snapshot, read, key: str, order: str) -> DataFrame:
    """The last row of each key. Only the batches since the base, and the base's rows of their keys, are sorted; the rest of the base is read as it lies."""
    if not now.deltas:
        return read(now.base)
    recent = read(*now.deltas)
    if now.base is None:
        return last_by_key(recent, key, [F.desc(order), F.desc("batch")])
    base, keys = read(now.base), recent.select(key).distinct()
    met = base.join(keys, key, "left_semi").unionByName(recent)
    return base.join(keys, key, "left_anti").unionByName(last_by_key(met, key, [F.desc(order), F.desc("batch")]))


def _reader(spark: SparkSession, table: str):
    return lambda *names: spark.read.parquet(*[f"{table}/{n}" for n in names])


def read_table(spark: SparkSession, table: str, key: str, order: str) -> DataFrame:
    """The table as of its newest snapshot."""
    return _resolved(snapshot(spark, table), _reader(spark, table), key, order).drop("batch")


def put(rows: DataFrame, batch: int, table: str, key: str, order: str, compact_after: int = 8) -> Snapshot:
    """Adds a batch: its last row of each key replaces an older one of the table (D-6 by `order`, then by batch).

    The batch's folder is written first and the manifest last, so a crash between them leaves
    the table as it was, and the batch, run again, writes the same folder anew. A batch that
    is in already changes nothing. After compact_after batches base and batches become a new
    base; the folders that it replaces are deleted with the next one, when no reader of
    the snapshot before needs them any more.
    """
    spark = rows.sparkSession
    now = snapshot(spark, table) or Snapshot(-1, None, [], [])
    if batch <= now.batch:
        return now
    name = f"batch-{batch}"
    last_by_key(rows, key, [F.desc(order)]).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{table}/{name}")
    new = Snapshot(batch, now.base, [*now.deltas, name], now.old)
    gone: list[str] = []
    if len(new.deltas) >= compact_after:
        base = f"base-{batch}"
        _resolved(new, _reader(spark, table), key, order).write.mode("overwrite").parquet(f"{table}/{base}")
        gone = new.old
        new = Snapshot(batch, base, [], [*([new.base] if new.base else []), *new.deltas])
    spark.createDataFrame([new], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{table}/manifest/{batch}")
    for folder in gone:
        remove_folder(spark, f"{table}/{folder}")
    if now.batch >= 0:
        remove_folder(spark, f"{table}/manifest/{now.batch}")
    return new

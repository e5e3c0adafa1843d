"""Upserts, removal and de-duplication of stored tables, as new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_images(images: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """D-5. images: image_id, image_data. Every image with the id that its content has: that of existing (image_id, image_hash), else the smallest here. Adds image_hash, canonical_id, is_new."""
    rows = images.withColumn("image_hash", F.sha2("image_data", 256))
    first = rows.groupBy("image_hash").agg(F.min("image_id").alias("_own"))
    if existing is not None:
        first = first.join(existing.groupBy("image_hash").agg(F.min("image_id").alias("_old")), "image_hash", "left")
    else:
        first = first.withColumn("_old", F.lit(None).cast("long"))
    out = rows.join(first, "image_hash")
    return out.withColumn("canonical_id", F.coalesce("_old", "_own")).withColumn("is_new", F.col("_old").isNull() & (F.col("image_id") == F.col("_own"))).drop("_old", "_own")


def upsert_chunks(existing: DataFrame, incoming: DataFrame, key: str = "chunk_uuid") -> DataFrame:
    """D-6. The rows of existing whose key does not come in, and all of incoming."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def last_by_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key; order: descending columns of a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def purge_documents(tables: dict[str, DataFrame], filenames: DataFrame) -> dict[str, DataFrame]:
    """D-10. tables: any of logs (log_id, source_name), chunks and images (log_id), vectors (filename), nodes and edges (filename). What is left of each without the documents of filenames; shared entities have no filename and stay."""
    gone = filenames.select("filename").distinct()
    out = {}
    if "logs" in tables:
        logs = tables["logs"]
        ids = logs.join(gone.withColumnRenamed("filename", "source_name"), "source_name", "left_semi").select("log_id").distinct()
        out["logs"] = logs.join(ids, "log_id", "left_anti")
        for name in ("chunks", "images"):
            if name in tables:
                out[name] = tables[name].join(ids, "log_id", "left_anti")
    for name in ("vectors", "nodes", "edges"):
        if name in tables:
            out[name] = tables[name].join(gone, "filename", "left_anti")
    return out

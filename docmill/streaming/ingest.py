"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.chunk import chunk_fixed
from docmill.operators.clean import normalize_whitespace
from docmill.streaming import snapshots


def ingest_chunks(docs: DataFrame) -> DataFrame:
    """What the batch and the stream do with documents (doc_id, text): clean, cut, name."""
    cut = chunk_fixed(normalize_whitespace(docs.select("doc_id", "text")))
    return cut.withColumn("chunk_uuid", F.substring(F.sha2(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.sha2("chunk", 256)), 256), 1, 32))


def stream_ingest(spark: SparkSession, inbox: str, out: str, checkpoint: str, schema: str = "doc_id long, text string", files_per_trigger: int = 8):
    """ST-1. Each new Parquet file of the inbox is cleaned, cut and written once. Returns the query; it ends when the inbox is read."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(inbox)
    return ingest_chunks(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_corpus(spark: SparkSession, inbox: str, table: str, status: str, checkpoint: str, taxonomy: DataFrame, sidecars: DataFrame | None = None, files_per_trigger: int = 8):
    """ST-1 with all steps of C-1: each new Parquet file of the inbox (doc_id, filename, path, text, ingest_date, ingestion_ts) is dispatched, cleaned, cut, typed and named as pipelines.ingest_corpus does, by joins with the static taxonomy and sidecars.

    Chunks go to the snapshot table `table` (see snapshots), so a file that comes again replaces
    its chunks; the status of each file to a folder for each batch below `status`, which a
    batch that runs again overwrites.
    """
    from docmill.plans.pipelines import ingest_corpus

    def put(batch: DataFrame, batch_id: int) -> None:
        rows, states = ingest_corpus(batch, taxonomy, sidecars=sidecars)
        states.write.mode("overwrite").parquet(f"{status}/batch={batch_id}")
        snapshots.put(rows, batch_id, table, "chunk_uuid", "ingestion_ts")

    files = spark.readStream.schema("doc_id long, filename string, path string, text string, ingest_date date, ingestion_ts timestamp").option("maxFilesPerTrigger", files_per_trigger).parquet(inbox)
    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(stream: DataFrame, table: str, checkpoint: str, key: str, order: str, compact_after: int = 8):
    """ST-2. Keeps the last row of each key, by order, in a snapshot table (see snapshots): a batch that runs again, after a crash too, leaves the table equal, and every compact_after batches it is compacted, so a read sorts no more than these."""

    def put(batch: DataFrame, batch_id: int) -> None:
        snapshots.put(batch, batch_id, table, key, order, compact_after)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, table: str, key: str, order: str) -> DataFrame:
    return snapshots.read_table(spark, table, key, order)


def stream_dedupe(stream: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """ST-3. The first row of each key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_status(stream: DataFrame, ts: str = "ts", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """ST-4. Counts by time window and status; rows later than the watermark are not counted."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window), "status").agg(F.count("*").alias("n"))


def drain(query) -> None:
    """Waits until an available-now query has read its input."""
    query.awaitTermination()


def run_to_table(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append", then: Callable | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns its Parquet output."""
    drain(stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    out = spark.read.schema(stream.schema).parquet(path)
    return then(out) if then else out

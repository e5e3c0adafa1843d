"""Sources and sinks: document folders, sidecar files, chunk, vector and graph tables, and JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.maintain import last_by_key


def scan_inbox(spark: SparkSession, path: str) -> DataFrame:
    """S-1. All .pdf and .md files below path, without sidecars: path, filename, length, mtime, doc_id (32 hex digits of the content's sha256)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.where(name.rlike(r"\.(pdf|md)$") & ~name.endswith(".meta.json")).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.col("modificationTime").alias("mtime"), F.substring(F.sha2("content", 256), 1, 32).alias("doc_id"))


def scan_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S-2. Text files as rows: filename, folders below the path's parent, text."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("p"))
    parts = F.split("p", "/")
    return rows.select(F.element_at(parts, -1).alias("filename"), F.slice(parts, F.size(parts) - 2, F.lit(2)).alias("folders"), F.col("value").alias("text"))


def write_bucketed(chunks: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """S-4 by id: all versions of chunks (chunk_uuid, content and others) as the table `name` at path, in buckets of chunk_uuid, with content_hash. Each bucket is one file; there should be so many that one is a few hundred megabytes. Texts are shuffled here, once, and not when versions are resolved (search.latest_bucketed)."""
    rows = chunks.withColumn("content_hash", F.xxhash64("content")).repartition(buckets, "chunk_uuid")
    rows.write.format("parquet").bucketBy(buckets, "chunk_uuid").option("path", path).saveAsTable(name)
    return chunks.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, buckets: int = 64) -> DataFrame:
    """What write_bucketed wrote at path, with as many buckets, under a name of this session's catalog."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by (chunk_uuid) into {buckets} buckets location '{path}'")
    return spark.table(name)


SIDECAR = "tier string, content_type string, source_kind string, ontology string, effective_date string, _corrupt string"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """S-3. <file>.meta.json as records keyed by the file they stand beside; unreadable ones have nulls."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").text(path).select("value", F.col("_metadata.file_path").alias("p"))
    rec = F.from_json("value", SIDECAR, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.select(F.regexp_replace("p", r"\.meta\.json$", "").alias("path"), rec.alias("r")).select("path", "r.tier", "r.content_type", "r.source_kind", "r.ontology", "r.effective_date")


def write_chunks(df: DataFrame, path: str, mode: str = "append") -> None:
    """S-4. Partitioned by the day of ingestion, so that versions of a time range are read alone."""
    df.withColumn("ingest_date", F.to_date("ingestion_ts")).write.mode(mode).partitionBy("ingest_date").parquet(path)


def write_vectors(df: DataFrame, path: str, order: list) -> None:
    """S-5. The last row of each chunk_uuid, by tier."""
    last_by_key(df, "chunk_uuid", order).write.mode("overwrite").partitionBy("tier").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """S-6. nodes: label and columns; edges: relation and columns; a folder for each label or relation."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


EVAL_SCHEMA = "ts_utc string, query string, requested_doc string, answer_sha256 string, sources array<struct<filename:string,page:int,type:string,tier:string,db_origin:string,score:double>>, metrics struct<faithfulness:double,relevance:double,hallucination:double,scope_violation:boolean,verdict:string>, llm_model string, eval_model string"


def write_eval_log(df: DataFrame, path: str) -> None:
    """S-7. Appends evaluation records as JSON lines; an answer is kept as its hash only."""
    rows = df.withColumn("answer_sha256", F.sha2("answer", 256)).drop("answer") if "answer" in df.columns else df
    rows.write.mode("append").json(path)


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    """S-7."""
    return spark.read.schema(EVAL_SCHEMA).json(path)


def write_audit_log(df: DataFrame, path: str) -> None:
    """S-8. Appends audit records as JSON lines; a prompt is kept as its hash and size only."""
    df.withColumn("prompt_sha256", F.sha2("prompt", 256)).withColumn("context_size", F.char_length("prompt")).drop("prompt").write.mode("append").json(path)

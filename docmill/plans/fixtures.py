"""Inputs of the registered queries, derived from the given tables; each with the same rule in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import index
from docmill.operators.chunk import windows
from docmill.operators.search import latest_versions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """The named columns of a table, dealt out by key to parts of at most about 100,000 rows, and to all cores: a file of one row group is one task, whatever its number of rows. Rows are counted from the footers of the files."""
    own = table(spark, sf_dir, name).select(key, *columns)
    return own.repartition(max(spark.sparkContext.defaultParallelism, -(-own.count() // 100_000)), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out by doc_id where the table has fewer files than the session has cores: a file of one row group is one task, and words and patterns are costly."""
    d, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return d.repartition(cores, "doc_id") if len(d.inputFiles()) < min(cores, 64) else d


FOLDERS = ("TIER_A_NORMATIVE", "TIER_B_GOVERNANCE", "TIER_C_EVIDENCES")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into pages of 1800 characters."""
    d = documents(spark, sf_dir)
    name = F.concat_ws("", "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename")
    return d.select("doc_id", name, F.posexplode(windows(F.col("text"), 1800, 0)).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


PAGES_SQL = """pg as (select doc_id, source || '_' || doc_id || '.md' as filename, cast(p as int) as page_no, substring(text, cast((p - 1) * 1800 + 1 as bigint), 1800) as text
 from (select *, unnest(range(1, cast(greatest(1, ceil(length(text) / 1800.0)) as bigint) + 1)) as p from documents))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in windows of 800 characters with a step of 600; every tenth document has a second, newer version."""
    d = documents(spark, sf_dir)
    name = F.concat_ws("", "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename")
    one = d.select("doc_id", name, F.posexplode(windows(F.col("text"), 800, 200)).alias("chunk_index", "content")).select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_uuid"),
        "doc_id",
        "filename",
        "chunk_index",
        F.expr("cast(chunk_index div 3 + 1 as int)").alias("page_no"),
        "content",
        F.expr("element_at(array('A', 'B', 'C'), cast(doc_id % 3 as int) + 1)").alias("tier"),
        F.expr("timestamp_micros(1704067200000000 + doc_id * 60000000)").alias("ingestion_ts"),
    )
    newer = one.where("doc_id % 10 = 0").withColumn("ingestion_ts", F.expr("ingestion_ts + interval 1 day")).withColumn("content", F.concat("content", F.lit(" (rev)")))
    return one.unionByName(newer)


CHUNKS_SQL = """c0 as (select doc_id, source || '_' || doc_id || '.md' as filename, text, unnest(range(0, greatest(length(text), 1), 600)) as b from documents),
c1 as (select doc_id || '_' || (b // 600) as chunk_uuid, doc_id, filename, cast(b // 600 as int) as chunk_index, cast((b // 600) // 3 + 1 as int) as page_no, substring(text, b + 1, 800) as content,
 (['A', 'B', 'C'])[cast(doc_id % 3 as int) + 1] as tier, make_timestamp(1704067200000000 + doc_id * 60000000) as ingestion_ts from c0),
chunks as (select * from c1 union all select chunk_uuid, doc_id, filename, chunk_index, page_no, content || ' (rev)', tier, ingestion_ts + interval 1 day from c1 where doc_id % 10 = 0)"""


_INDEXES: dict[tuple, index.TextIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> index.TextIndex:
    """The stored index of the newest versions of all chunks, made once in a session for each folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = index.build_index(with_types(latest_versions(chunks(spark, sf_dir))))
    return _INDEXES[key]


def with_types(rows: DataFrame) -> DataFrame:
    """Every seventh chunk is a table."""
    return rows.withColumn("toon_type", F.when(F.col("chunk_index") % 7 == 0, "table").otherwise("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the first six words of each benchmark text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.expr("array_join(slice(split(text, ' '), 1, 6), ' ')").alias("query"))


ASKED_SQL = "asked as (select item_id as query_id, array_to_string(string_split(text, ' ')[1:6], ' ') as query from benchmark)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored hits of three channels: line items, with their order as query."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("query_id"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_uuid"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".md")).alias("filename"),
        (F.col("l_partkey") % 4).cast("int").alias("page"),
        F.expr("element_at(array('A', 'B', 'C'), cast(l_suppkey % 3 as int) + 1)").alias("tier"),
        F.col("l_extendedprice").cast("double").alias("vector_score"),
        F.col("l_quantity").cast("double").alias("text_score"),
        F.col("l_discount").cast("double").alias("graph_score"),
    )


CANDIDATES_SQL = """cand as (select l_orderkey as query_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber as chunk_uuid, 'src' || (l_suppkey % 3) || '.md' as filename,
 cast(l_partkey % 4 as int) as page, (['A', 'B', 'C'])[cast(l_suppkey % 3 as int) + 1] as tier, cast(l_extendedprice as double) as vector_score, cast(l_quantity as double) as text_score, cast(l_discount as double) as graph_score from lineitem)"""

"""The corpus pipeline: language identification, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to
the shared folder and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import materialize, table
from docmill.llm.langid import held_out, reject_unknown, train
from docmill.llm.nearcopies import keep_one
from docmill.llm.packing import pack_documents
from docmill.llm.queries import vocabulary
from docmill.llm.secrets import redact_secrets
from docmill.llm.vocab import added_tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text has no letter or no language that the model finds likely at all."""
    return reject_unknown(docs, train(docs, ~held_out()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies, whole rows told apart by all their columns.

    Near copies share 0.8 or more of their five-word shingles, or are linked by such copies.
    SimHash groups and MinHash bands propose links, which are checked on the whole sets.
    """
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; all documents stay."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows, as in the query of the packing operator."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), added_tokens(vocabulary("byte_bpe_50k.json"))).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: Fingerprints, a trained classifier, an automaton and a tokeniser: SQL expresses none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

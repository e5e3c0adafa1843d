"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.sources.shared import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage.

    The copy survives the loss of executors, unlike a cached table.
    """
    return stored(df, new_folder(df.sparkSession, name))


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_values(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about `most` bytes of text, so that work memory stays bounded."""
    import pyarrow.compute as pc

    size, begun, held = pc.binary_length(batch.column(text)).to_pylist(), 0, 0
    for i, n in enumerate(size):
        held += n or 0
        if held >= most:
            yield batch.slice(begun, i + 1 - begun)
            begun, held = i + 1, 0
    if begun < batch.num_rows:
        yield batch.slice(begun)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Deals rows out evenly over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hex64(column):
    """A long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")

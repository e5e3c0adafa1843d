"""Columns that a model computes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scorer(df: DataFrame, load: Callable[[], Callable], in_cols: list[str], out_col: str, kind: str) -> DataFrame:
    """U-1. load() runs once in each task and returns a function from batches of the input columns (pandas Series) to a batch of results."""

    @F.pandas_udf(kind)
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            yield model(*columns)

    @F.pandas_udf(kind)
    def score_one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for column in batches:
            yield model(column)

    return df.withColumn(out_col, (score_one if len(in_cols) == 1 else score)(*in_cols))

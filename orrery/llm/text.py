"""Column expressions for words and letters, all of them built-in functions."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z alone. lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(col: Column) -> Column:
    """Runs of characters other than the six ASCII spaces; none for an empty text."""
    return F.filter(F.split(col, SPACES), lambda w: w != "")


def sliced(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Parts of the batches: what a function makes of one part is bounded, however many rows Spark sends at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def through_pandas(df: DataFrame, run, schema: str, key: str = "doc_id") -> DataFrame:
    """mapInPandas over small parts, with the key as text on the way: pandas would turn a column of integers with a null into floats."""
    kind = df.schema[key].dataType
    out = df.withColumn(key, F.col(key).cast("string")).mapInPandas(lambda batches: run(sliced(batches)), f"{key} string, {schema}")
    return out.withColumn(key, F.col(key).cast(kind))


def sum_of(col: Column) -> Column:
    return F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + x)

"""Joins of a long table, whose keys may be hot, with a table that has at most one row a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_one_row_a_key(df: DataFrame, single: DataFrame, keys: list[str], spread: str | Column, broadcast_rows: int, how: str = "inner", salts: int = 16) -> DataFrame:
    """`single` is a written table: it is broadcast if its counted rows are few, and else copied once for every salt.

    Rows of `df` get their salt from `spread`, so a key with very many rows is met in several tasks.
    """
    if single.count() <= broadcast_rows:
        return df.join(F.broadcast(single), keys, how)
    single = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(single, [*keys, "_salt"], how).drop("_salt")

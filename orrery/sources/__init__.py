"""Tables to read: the countries dimension and the Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .countries import CONTINENTS, continent_ordinal, countries

__all__ = ["CONTINENTS", "continent_ordinal", "countries", "preview", "table"]


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def preview(df: DataFrame, rows: int = 1000) -> DataFrame:
    """At most `rows` rows, as an interface for people would show."""
    return df.limit(rows)

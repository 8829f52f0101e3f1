"""Keeping or dropping rows of a table by a table of ids.

A row without an id is a document of its own: it equals no other, whatever its id says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

BROADCAST_ROWS = 1_000_000


def keyed(docs: DataFrame, name: str = "_key", key: str = "doc_id") -> DataFrame:
    """Adds an id as text that no row lacks: rows without an id get the number of their place.

    Places are the same in every run over a written table; a number stands behind a letter,
    so that it equals no id.
    """
    return docs.withColumn(name, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))))


def _joined(docs: DataFrame, ids: DataFrame, how: str, key: str) -> DataFrame:
    """Null ids match nothing. The ids are written and counted; only few are broadcast."""
    ids = Scratch(docs.sparkSession, "ids").save(ids.select(F.col(key).alias("_id")).where("_id is not null").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(ids, docs[key] == ids["_id"], how)


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose id is among the ids, and those without an id."""
    return _joined(docs.where(F.col(key).isNotNull()), ids, "left_semi", key).unionByName(docs.where(F.col(key).isNull()))


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose id is not among the ids; those without an id all stay."""
    return _joined(docs, ids, "left_anti", key)


def one_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each id, the one with the longest text, where any is repeated; rows without an id all stay.

    Of equally long texts the greatest row in the order of the columns stays. Repeated ids
    are found and reduced by partial aggregates, so an id may have any number of rows.
    """
    repeated = Scratch(docs.sparkSession, "repeated").save(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if repeated.isEmpty():
        return docs
    again = _joined(docs, repeated, "left_semi", key)
    best = again.groupBy(F.col(key).alias("_of")).agg(F.max(F.struct(F.length(text).alias("_length"), F.struct(*docs.columns).alias("_row"))).alias("_m"))
    return without(docs, repeated, key).unionByName(best.select("_m._row.*"))

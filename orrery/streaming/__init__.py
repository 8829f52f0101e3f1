"""Identifiers in streams: ids for new rows, and the time that ids carry as the time of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timestamp_from_uuid_v7, with_ksuid_microsecond, with_ksuid_second, with_uuid_v6, with_uuid_v7

KINDS = {"uuid_v6": with_uuid_v6, "uuid_v7": with_uuid_v7, "ksuid_second": with_ksuid_second, "ksuid_microsecond": with_ksuid_microsecond}


def with_id(df: DataFrame, kind: str = "uuid_v7", name: str = "id") -> DataFrame:
    """Adds an identifier to each row of a streaming or batch frame.

    A batch that is run again after a failure gets new ids; write through a sink that
    commits a batch once.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of identifier: {kind}")
    return KINDS[kind](df, name)


def counts_by_time_of_id(df: DataFrame, window: str = "1 minute", late: str = "5 minutes", name: str = "id") -> DataFrame:
    """(start, n): rows for each window of the times in a column of version 7 UUIDs, each UUID counted once.

    The ids' own time drives the watermark, so rows that come later than `late` are dropped,
    and repeated deliveries within it count once. A null id is in no window.
    """
    stamped = df.where(F.col(name).isNotNull()).select(F.col(name).alias("_id"), timestamp_from_uuid_v7(name).cast("timestamp").alias("_at"))
    once = stamped.withWatermark("_at", late).dropDuplicatesWithinWatermark(["_id"]) if df.isStreaming else stamped.dropDuplicates(["_id"])
    return once.groupBy(F.window("_at", window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")

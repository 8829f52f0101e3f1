"""The clock and the random bits behind generated identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Read for every row; current_timestamp() has one value for a whole statement.
NOW_MICROS_SQL = "unix_micros(cast(reflect('java.time.Instant', 'now') as timestamp))"
#: 108 random bits as 27 hex digits: a random UUID without its version and variant digits.
RANDOM_HEX_SQL = "concat(substr({u}, 1, 12), substr({u}, 18, 15))"


def micros_of(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), ts)


def with_clock(df: DataFrame, micros: str, payload: str) -> DataFrame:
    """Adds one clock reading and 54 random hex digits to every row, in a projection of their own.

    Expressions above refer to these columns, so an identifier that uses its clock several
    times sees one value.
    """
    first, second = (F.replace(F.uuid(), F.lit("-"), F.lit("")) for _ in range(2))
    df = df.withColumns({micros: F.expr(NOW_MICROS_SQL), "_u1": first, "_u2": second})
    return df.withColumn(payload, F.concat(F.expr(RANDOM_HEX_SQL.format(u="_u1")), F.expr(RANDOM_HEX_SQL.format(u="_u2")))).drop("_u1", "_u2")

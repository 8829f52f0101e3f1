"""UUIDs of versions 6 and 7 as text in the canonical form, whose order is the order of the bytes.

The constructors are pure: they take microseconds since 1970 and a payload of at least 16
hex digits. Generators call them on a clock reading and random bits of each row.

Modes: "spec" takes whole seconds and milliseconds from the clock as they are, so that ids
sort by time. "compat" rounds them half up first and, for version 6, computes ticks in
double precision; its ids can run up to a second ahead and out of order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clock import with_clock

#: Seconds from 1582-10-15, the first day of the Gregorian calendar, to 1970-01-01.
GREGORIAN_SECONDS = 12_219_292_800

_WORDS = {
    (7, "spec"): "((({us}) div 1000) << 12) | ((({us}) % 1000) << 2)",
    (7, "compat"): "((((({us}) + 500000) div 1000000) * 1000 + ((({us}) % 1000000) + 500) div 1000) << 12) | ((({us}) % 1000) << 2)",
    (6, "spec"): f"(({{us}}) + {GREGORIAN_SECONDS}000000) * 10",
    (6, "compat"): f"cast((cast((({{us}}) + 500000) div 1000000 + {GREGORIAN_SECONDS} as double) * 1e6D + (({{us}}) % 1000000)) * 10D as bigint)",
}
_TEXT = (
    "concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-{version}', substr({h}, 13, 3), '-', "
    "substr('89ab', cast(conv(substr({r}, 1, 1), 16, 10) as int) % 4 + 1, 1), substr({r}, 2, 3), '-', substr({r}, 5, 12))"
)


def uuid_sql(version: int, mode: str, us: str, payload: str) -> str:
    """SQL of the constructor over two SQL expressions."""
    word = _WORDS[version, mode].format(us=us)
    return _TEXT.format(h=f"lower(lpad(hex({word}), 15, '0'))", r=payload, version=version)


def uuid_v6_at(us: str, payload: str, mode: str = "spec") -> Column:
    """A version 6 UUID from a column of microseconds and a column of hex digits."""
    return F.expr(uuid_sql(6, mode, f"`{us}`", f"`{payload}`"))


def uuid_v7_at(us: str, payload: str, mode: str = "spec") -> Column:
    """A version 7 UUID from a column of microseconds and a column of hex digits."""
    return F.expr(uuid_sql(7, mode, f"`{us}`", f"`{payload}`"))


def _generated(df: DataFrame, name: str, make) -> DataFrame:
    return with_clock(df, "_us", "_hex").withColumn(name, make("_us", "_hex")).drop("_us", "_hex")


def with_uuid_v6(df: DataFrame, name: str = "id") -> DataFrame:
    """Adds a new version 6 UUID to every row. Ids differ in every run: write them before use."""
    return _generated(df, name, uuid_v6_at)


def with_uuid_v7(df: DataFrame, name: str = "id") -> DataFrame:
    """Adds a new version 7 UUID to every row. Ids differ in every run: write them before use."""
    return _generated(df, name, uuid_v7_at)


def hex_of_uuid_sql(value: str) -> str:
    """32 lower-case digits of a UUID in any accepted spelling; others raise an error, null stays null."""
    plain = f"lower(regexp_replace({value}, '[-{{}}]', ''))"
    return f"if({plain} rlike '^[0-9a-f]{{32}}$' or {value} is null, {plain}, raise_error(concat('invalid uuid: ', {value})))"


def uuid_normalized(value: str) -> Column:
    """The canonical form of a column of UUIDs in upper case, braces or without hyphens."""
    h = hex_of_uuid_sql(f"`{value}`")
    return F.regexp_replace(F.expr(h), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")

"""The time in a version 7 UUID, in a time zone of choice.

The result has no time zone and whole seconds: milliseconds are cut off. The version digit
is not looked at. A null argument gives null. The session's time zone plays no part.
"""

from __future__ import annotations

import re
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import hex_of_uuid_sql

#: Abbreviations that name a fixed offset.
ABBREVIATIONS = {"EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "CET": "+01:00", "CEST": "+02:00", "BST": "+01:00", "Z": "+00:00"}

OFFSET = re.compile(r"(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?", re.I)


def canonical_zone(zone: str) -> str:
    """The name Spark knows a zone by: names in any case; bare offsets count hours west of UTC, as POSIX does."""
    if m := OFFSET.fullmatch(zone.strip()):
        sign = "-" if m[1] == "+" else "+"
        return f"{sign}{int(m[2]):02d}:{m[3] or '00'}"
    if fixed := ABBREVIATIONS.get(zone.strip().upper()):
        return fixed
    known = {z.lower(): z for z in available_timezones()}
    if zone.strip().lower() not in known:
        raise ValueError(f"time zone not recognized: {zone}")
    return known[zone.strip().lower()]


def _by_rule(zone: str) -> str:
    """A lower-case name with capitals after / and _."""
    return "/".join("_".join(q[:1].upper() + q[1:] for q in p.split("_")) for p in zone.split("/"))


def zone_sql(zone: str) -> str:
    """The same for a SQL expression. Names in any case are spelled by rule, or by a map of those that the rule misses."""
    fixed = ", ".join(f"'{k}', '{v}'" for k, v in ABBREVIATIONS.items())
    missed = ", ".join(f"'{z.lower()}', '{z}'" for z in sorted(available_timezones()) if _by_rule(z.lower()) != z)
    offset = r"^(?i)(?:UTC|GMT)?([+-])([0-9]{1,2}):?([0-9]{2})?$"
    sign = f"if(regexp_extract({zone}, r'{offset}', 1) = '+', '-', '+')"
    hours = f"lpad(regexp_extract({zone}, r'{offset}', 2), 2, '0')"
    minutes = f"rpad(regexp_extract({zone}, r'{offset}', 3), 2, '0')"
    spelled = f"array_join(transform(split({zone}, '/'), p -> array_join(transform(split(p, '_'), q -> initcap(q)), '_')), '/')"
    return (
        f"case when {zone} rlike r'{offset}' then concat({sign}, {hours}, ':', {minutes}) "
        f"else coalesce(try_element_at(map({fixed}), upper({zone})), try_element_at(map({missed}), lower({zone})), {spelled}) end"
    )


def decode_sql(value: str, zone: str) -> str:
    """SQL over an expression for the UUID and one for a zone that Spark knows."""
    millis = f"cast(conv(substr({hex_of_uuid_sql(value)}, 1, 12), 16, 10) as bigint)"
    return f"convert_timezone('UTC', {zone}, timestampadd(SECOND, {millis} div 1000, timestamp_ntz'1970-01-01'))"


def timestamp_from_uuid_v7(value: str, timezone: str | None = "UTC") -> Column:
    """The timestamp in a column of UUIDs, as clocks in `timezone` show it."""
    if timezone is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.expr(decode_sql(f"`{value}`", f"'{canonical_zone(timezone)}'"))

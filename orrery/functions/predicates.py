"""Parity of integers. A null is not even, and so is odd: the two stay exact complements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The remainder has the sign of the dividend, so it is compared with 0 and never with 1.
IS_EVEN_SQL = "coalesce({value} % 2 = 0, false)"
IS_ODD_SQL = "not coalesce({value} % 2 = 0, false)"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_even(value: str | Column) -> Column:
    return F.coalesce(_column(value) % 2 == 0, F.lit(False))


def is_odd(value: str | Column) -> Column:
    return ~is_even(value)

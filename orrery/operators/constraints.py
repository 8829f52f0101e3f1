"""Keys, required columns and label domains, checked as queries: Parquet tables enforce none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: list[str] | None = None, required: list[str] | None = None, domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(constraint, violations): how many rows break each constraint.

    Required columns and domains are counted in one pass without a shuffle of rows; the key
    takes one aggregate on the key.
    """
    required = [*(key or []), *(c for c in required or [] if c not in (key or []))]
    counts = {f"not null: {c}": F.count_if(F.col(c).isNull()) for c in required}
    counts |= {f"domain: {c}": F.count_if(~F.col(c).isin(*labels)) for c, labels in (domains or {}).items()}
    parts = []
    if counts:
        each = df.agg(*[n.alias(k) for k, n in counts.items()])
        parts.append(each.select(F.explode(F.array(*[F.struct(F.lit(k).alias("constraint"), F.col(f"`{k}`").alias("violations")) for k in counts])).alias("x")).select("x.*"))
    if key:
        repeated = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(repeated.agg(F.lit(f"key: {', '.join(key)}").alias("constraint"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_valid(df: DataFrame, **constraints) -> DataFrame:
    """The frame itself; raises an error that names the constraints that don't hold."""
    broken = violations(df, **constraints).where("violations > 0").collect()  # a row for each constraint
    if broken:
        raise ValueError("; ".join(f"{r.constraint} ({r.violations} rows)" for r in broken))
    return df

"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
integer with a bit for each rule that failed. A policy is a version name with a mask of
the rules that it enforces, so that a new policy, or the question what a policy would
keep without one of its rules, needs the ledger only and never the texts again.

Defined cases: a null text counts as an empty one and fails `few_words`; repeated rows
stay repeated, each with its own ledger row; an empty table gives an empty ledger.
Columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sum_of, text_or_empty, words

#: Positions of windows take the low bits of a sorted key, hashes the rest.
POSITION_BITS = 24
_POSITIONS = 1 << POSITION_BITS


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str
    """SQL predicate over the measurements."""


#: The place of a rule is its bit: append new ones, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("exclamations", "10 * n_exclamations > 3 * n_words"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask_of("few_words", "repeated_windows")
#: Versions of the policy; a document is kept if it fails no rule of the mask.
POLICIES = {
    "base-1": BASE,
    "form-1": mask_of("few_words", "repeated_windows", "symbols", "capitals", "exclamations"),
    "web-1": mask_of("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "capitals", "exclamations"),
}
PRODUCTION = "web-1"


def _same_hash(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.lit(-_POSITIONS)) == b.bitwiseAND(F.lit(-_POSITIONS))


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key and the measurements that the rules read.

    Words in repeated windows are found inside the row. Hashes of the windows, with their
    positions in the low bits, are sorted as longs; neighbours with equal hashes are only
    candidates, and the words of these are then sorted and compared.
    """
    out = df.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("body"))
    out = out.select("doc_id", "body", words(F.col("body")).alias("w"), F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("filled"))
    w, n = F.col("w"), F.size("w")
    window_hash = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    starts = F.sequence(F.lit(0), n - 3)
    out = out.select(
        "doc_id",
        "w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("body", F.lit("!")).cast("long").alias("n_exclamations"),
        F.size("filled").cast("long").alias("n_lines"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        F.when((n >= 3) & (n < _POSITIONS), F.sort_array(F.transform(starts, lambda i: window_hash(i).bitwiseAND(F.lit(-_POSITIONS)).bitwiseOR(i.cast("long"))))).alias("keys"),
    )
    keys = F.col("keys")
    out = out.withColumn(
        "starts",
        F.when(n < 3, F.array().cast("array<long>"))
        .when(n >= _POSITIONS, F.sequence(F.lit(0).cast("long"), (n - 3).cast("long")))
        .otherwise(
            F.transform(
                F.filter(keys, lambda x, k: ((k > 0) & _same_hash(x, F.get(keys, F.greatest(k - 1, F.lit(0))))) | _same_hash(x, F.get(keys, k + 1))),
                lambda x: x.bitwiseAND(F.lit(_POSITIONS - 1)),
            )
        ),
    ).drop("keys")
    window = lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("words"), p.cast("long").alias("p"))
    out = out.withColumn("found", F.sort_array(F.transform("starts", lambda p: window(p.cast("int"))))).drop("w", "starts")
    found = F.col("found")
    twice = F.filter(found, lambda x, k: ((k > 0) & (x["words"] == F.get(found, F.greatest(k - 1, F.lit(0)))["words"])) | (x["words"] == F.get(found, k + 1)["words"]))
    out = out.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("found")
    at = F.col("at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, k + 1) - p, F.lit(3).cast("long"))))
    return out.withColumn("n_repeat_words", sum_of(covered)).drop("at")


def evaluate(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `failed_rules`, the bitmask of all rules that a row fails."""
    bits = F.lit(0)
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << k)).otherwise(F.lit(0)))
    return measured.withColumn("failed_rules", bits)


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return evaluate(measure(df, key, text))


def apply_policy(entries: DataFrame, policy: str | int = PRODUCTION) -> DataFrame:
    """Adds `kept` for a named policy or a mask; no rule is evaluated anew."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return entries.withColumn("kept", F.col("failed_rules").bitwiseAND(F.lit(mask)) == 0)


def ablations(entries: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For every policy and rule of it: rows that fail the rule, rows that fail it alone,
    and rows kept with and without it. One pass: rows are first counted by bitmask, so
    what follows handles at most 2 ** len(RULES) rows.
    """
    spark = entries.sparkSession
    cases = [(p, r.name, m, BIT[r.name]) for p, m in (policies or POLICIES).items() for r in RULES if m & BIT[r.name]]
    values = ", ".join(f"('{p}', '{r}', {m}, {b})" for p, r, m, b in cases)
    plan = spark.sql(f"select * from values {values} as t(policy, rule, mask, bit)")
    counts = entries.groupBy("failed_rules").count()
    each = counts.select("failed_rules", "count", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit")) for p, r, m, b in cases])).alias("c")).select("failed_rules", "count", "c.*")
    enforced = F.col("failed_rules").bitwiseAND(F.col("mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(F.lit(0)))
    found = each.groupBy("policy", "rule").agg(
        total(enforced.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(enforced == F.col("bit")).alias("failed_alone"),
        total(enforced == 0).alias("kept"),
        total(enforced.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )
    return plan.select("policy", "rule").join(found, ["policy", "rule"], "left").fillna(0)

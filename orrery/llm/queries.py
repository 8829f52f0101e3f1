"""The queries of this subpackage, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, decontamination, html_extraction, license_scan, near_dedup, packing, pii, quality_rules, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(entries).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed_rules").bitwiseAND(F.lit(quality_rules.BASE)) != 0).alias("base_failed"), "kept", "failed_rules"
    )


OP2_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as body from documents
), parts as (
  select doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as filled
  from cut
), windows as (
  select doc_id, p, count(*) over (partition by doc_id, s) as n
  from (select doc_id, unnest(range(1, len(w) - 1)) as p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as s
        from parts)
), covered as (
  select doc_id, count(distinct p + k) as n_repeat_words
  from windows, (values (0), (1), (2)) as o(k) where n > 1 group by doc_id
), measured as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]')) as n_symbols,
         len(regexp_extract_all(body, '[A-Z]')) as n_capitals,
         len(regexp_extract_all(body, '!')) as n_exclamations,
         len(filled) as n_lines, len(filled) - len(list_distinct(filled)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words
  from parts left join covered using (doc_id)
), judged as (
  select *, (n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int
    + 4 * (10 * n_symbols > n_words)::int + 8 * (n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines)::int
    + 16 * (word_chars < 2 * n_words)::int + 32 * (word_chars > 20 * n_words)::int
    + 64 * (2 * n_capitals > word_chars)::int + 128 * (10 * n_exclamations > 3 * n_words)::int as failed_rules
  from measured
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (failed_rules & 3) <> 0 as base_failed, failed_rules = 0 as kept, failed_rules::int as failed_rules
from judged
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy would keep without each of its rules, from the ledger of op2."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def _ablations_sql() -> str:
    cases = ", ".join(f"('{p}', '{r}', {m}, {quality_rules.BIT[r]})" for p, m in quality_rules.POLICIES.items() for r in quality_rules.BIT if m & quality_rules.BIT[r])
    return f"""
with entries as ({OP2_SQL}), cases as (select * from (values {cases}) as t(policy, rule, mask, bit))
select policy, rule, (count(*) filter (failed_rules & bit <> 0))::bigint as failed, (count(*) filter (failed_rules & mask = bit))::bigint as failed_alone,
  (count(*) filter (failed_rules & mask = 0))::bigint as kept, (count(*) filter ((failed_rules & mask) - (failed_rules & bit) = 0))::bigint as kept_without
from entries cross join cases group by policy, rule
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.assign(table(spark, sf_dir, "documents"), near_dedup.Params(shingle=4))


OP3_SQL = r"""
with recursive cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from cut
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * shared >= 80 * (x.n + y.n - shared)
), reach as (
  select doc_id as a, doc_id as b from cut
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from least left join sizes using (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from (select item_id, w, least(len(w), 10) as n from item_words where len(w) > 0))
), places as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from words, (select distinct n from windows) where len(w) >= n)
), hits as (
  select doc_id, item_id, i, n from places join windows using (n, s)
), hit_words as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id
), hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii": op8_pii,
    "op9_class_ngrams": op9_class_ngrams,
    "op10_packing": op10_packing,
    "quality_ablations": quality_ablations,
}

#: The others can't be put in SQL; tests hold them against plain models.
ORACLES: dict[str, str] = {
    "op1_license_scans": license_scan.oracle_sql(),
    "op2_quality_rules": OP2_SQL,
    "quality_ablations": _ablations_sql(),
    "op3_minhash_near_dedup": OP3_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
}

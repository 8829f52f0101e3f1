"""One query for each function and table, composed with Spark's own operators, and its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import base62_decode, base62_encode, is_even, is_odd, ksuid_microsecond_at, ksuid_second_at, timestamp_from_uuid_v7, uuid_v6_at, uuid_v7_at
from ..functions import with_ksuid_microsecond, with_ksuid_second, with_uuid_v6, with_uuid_v7
from ..functions.clock import micros_of
from ..functions.ksuid import ALPHABET, EPOCH
from ..operators import Registry, violations
from ..operators.registry import EXTENSIONS
from ..sources import CONTINENTS, continent_ordinal, countries, table
from ..sources.countries import upgrade
from ..streaming import counts_by_time_of_id

Query = Callable[[SparkSession, str], DataFrame]


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, its microseconds and a payload that is the same in any engine."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", micros_of("ts").alias("us"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("r"))


def is_even_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("k"), "o_totalprice")
    return orders.groupBy(is_even("k").alias("even")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def is_odd_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("k"), "o_orderstatus")
    return orders.groupBy(is_odd("k").alias("odd"), "o_orderstatus").agg(F.count("*").alias("n"), F.min("k").alias("least"))


def parity_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.nullif("l_linenumber", F.lit(3)).alias("v"))
    return lines.groupBy("v", is_even("v").alias("even"), is_odd("v").alias("odd")).agg(F.count("*").alias("n"))


def parity_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(is_even(F.col("o_orderkey").cast("int"))).select("o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").where(is_odd(F.col("c_custkey").cast("int"))).select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _id_at(make, mode: str) -> Query:
    return lambda spark, sf_dir: _stamped(spark, sf_dir).select("event_id", make("us", "r", mode).alias("id"))


def base62_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select("o_orderkey", F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    coded = keys.withColumn("t", base62_encode("h"))
    same = coded.withColumn("back", base62_decode("t"))
    return same.agg(F.count("*").alias("n"), F.countDistinct("t").alias("n_distinct"), F.bool_and(F.col("back") == F.col("h")).alias("same"))


def _decoded(zone: str) -> Query:
    return lambda spark, sf_dir: _stamped(spark, sf_dir).select("event_id", uuid_v7_at("us", "r").alias("id")).select("event_id", timestamp_from_uuid_v7("id", zone).alias("ts"))


def ts_from_v7_null_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _stamped(spark, sf_dir).select("event_id", F.when(is_even("event_id"), uuid_v7_at("us", "r")).alias("id"))
    return ids.select("event_id", timestamp_from_uuid_v7("id").alias("ts"), timestamp_from_uuid_v7("id", None).alias("ts_no_zone"))


def _invariants(make, pattern: str) -> Query:
    """Generated ids can't be compared; what must hold of them can."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make(table(spark, sf_dir, "events").select("event_id"), "id")
        return made.groupBy("id").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.bool_and(F.col("id").rlike(pattern)).alias("all_match"))

    return query


def id_order_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in time whose ids are out of order, inside each user's events."""
    ids = table(spark, sf_dir, "events").select("user_id", "event_id", micros_of("ts").alias("us"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("r"))
    ids = ids.select("user_id", "us", uuid_v7_at("us", "r").alias("v7"), uuid_v6_at("us", "r").alias("v6"))
    w = Window.partitionBy("user_id").orderBy("us")
    ids = ids.select(*[((F.lag(c).over(w) > F.col(c)) & (F.lag("us").over(w) < F.col("us"))).alias(c) for c in ("v6", "v7")])
    return ids.agg(F.count("*").alias("n"), F.count_if("v6").alias("inversions_v6"), F.count_if("v7").alias("inversions_v7"))


def countries_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries(spark)


def countries_by_continent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries(spark).groupBy("continent").agg(F.count("*").alias("n"), F.min("iso3").alias("first_iso3")).withColumn("ordinal", continent_ordinal("continent")).orderBy("ordinal")


def countries_null_vs_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries(spark).agg(F.count("*").alias("n"), F.count_if(F.col("local_name").isNull()).alias("n_null"), F.count_if(F.col("local_name") == "").alias("n_empty"))


def countries_topk_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = countries(spark).withColumn("rank", F.row_number().over(Window.partitionBy("continent").orderBy("iso3")))
    return ranked.where("rank <= 3").withColumn("ordinal", continent_ordinal("continent")).orderBy("ordinal", "rank").select("continent", "ordinal", "rank", "iso3", "name")


def countries_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = countries(spark).withColumn("k", F.row_number().over(Window.orderBy("iso3")) - 1)
    joined = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("k"))
    return joined.groupBy("continent").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def countries_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number for all rows in the order of iso3, and one for those of 0.0.1 in the order of their identity."""

    def digest(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
        lines = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line")))).alias("all"), F.count("*").alias("n"))  # 249 rows
        return lines.select("n", F.md5(F.array_join(F.transform("all", lambda x: x["line"]), "\n").cast("binary")).alias("digest"))

    names = ["name", "iso2", "iso3", "local_name", "continent"]
    new = digest(countries(spark), "iso3", names).select(F.lit("0.0.2").alias("version"), "n", "digest")
    return new.unionByName(digest(countries(spark, "0.0.1"), "id", ["id", *names]).select(F.lit("0.0.1").alias("version"), "n", "digest"))


def countries_v1_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = upgrade(countries(spark, "0.0.1")), countries(spark, "0.0.2")
    one = lambda df, k: df.agg(F.lit(k).alias("difference"), F.count("*").alias("n"))
    return one(old.exceptAll(new), "only in 0.0.1").unionByName(one(new.exceptAll(old), "only in 0.0.2"))


def countries_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(countries(spark), key=["iso3"], required=["iso2"], domains={"continent": CONTINENTS})


def countries_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is null, not unique or nullable before and after the upgrade."""
    old = countries(spark, "0.0.1")
    one = lambda df, version: df.agg(F.count("*").alias("n"), F.countDistinct("iso3").alias("n_keys"), F.count_if(F.col("iso3").isNull()).alias("n_null")).select(F.lit(version).alias("version"), F.lit(df.schema["iso3"].nullable).alias("nullable"), "n", "n_keys", "n_null")
    return one(old, "0.0.1").unionByName(one(upgrade(old), "0.0.2"))


def _installed(spark: SparkSession) -> None:
    Registry(spark).create_extension("identifiers", if_not_exists=True)


def _sql_invariants(function: str, pattern: str) -> Query:
    """The same of ids that the function without arguments makes in SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _installed(spark)
        made = table(spark, sf_dir, "events").select(F.expr(f"{function}()").alias("id"))
        return made.groupBy("id").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.bool_and(F.col("id").rlike(pattern)).alias("all_match"))

    return query


def sql_ts_from_v7_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoder in SQL, with names of zones in odd cases and from a column."""
    _installed(spark)
    ids = _stamped(spark, sf_dir).select("event_id", uuid_v7_at("us", "r").alias("id"))
    zones = F.array(*[F.lit(z) for z in ("UTC", "Europe/paris", "america/port-au-prince", "etc/gmt+5", "ASIA/KOLKATA", "+05:30")])
    ids = ids.withColumn("zone", F.get(zones, (F.col("event_id") % 6).cast("int")))
    return ids.select("event_id", F.expr("timestamp_from_uuid_v7(id, zone)").alias("ts"))


def ids_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the hour that their ids carry; the plan is the same on a stream."""
    ids = _stamped(spark, sf_dir).select(uuid_v7_at("us", "r").alias("id"))
    return counts_by_time_of_id(ids, "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def extension_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Registry(spark).available_extensions()


def extension_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Registry(spark).available_extension_versions()


V6 = "^[0-9a-f]{8}-[0-9a-f]{4}-6[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
V7 = V6.replace("-6", "-7", 1)
KSUID = "^[0-9A-Za-z]{27}$"

QUERIES: dict[str, Query] = {
    "is_even_orders": is_even_orders,
    "is_odd_orders": is_odd_orders,
    "parity_nulls": parity_nulls,
    "parity_filter_join": parity_filter_join,
    "uuid_v7_at_events": _id_at(uuid_v7_at, "spec"),
    "uuid_v7_at_compat": _id_at(uuid_v7_at, "compat"),
    "uuid_v6_at_events": _id_at(uuid_v6_at, "spec"),
    "uuid_v6_at_compat": _id_at(uuid_v6_at, "compat"),
    "ksuid_second_at_events": _id_at(ksuid_second_at, "spec"),
    "ksuid_micro_at_events": _id_at(ksuid_microsecond_at, "spec"),
    "ksuid_second_at_compat": _id_at(ksuid_second_at, "compat"),
    "ksuid_micro_at_compat": _id_at(ksuid_microsecond_at, "compat"),
    "base62_roundtrip": base62_roundtrip,
    "ts_from_v7_utc": _decoded("UTC"),
    "ts_from_v7_paris": _decoded("Europe/Paris"),
    "ts_from_v7_newyork": _decoded("america/new_york"),
    "ts_from_v7_null_args": ts_from_v7_null_args,
    "gen_v6_invariants": _invariants(with_uuid_v6, V6),
    "gen_v7_invariants": _invariants(with_uuid_v7, V7),
    "gen_ksuid_s_invariants": _invariants(with_ksuid_second, KSUID),
    "gen_ksuid_us_invariants": _invariants(with_ksuid_microsecond, KSUID),
    "id_order_window": id_order_window,
    "countries_scan": countries_scan,
    "countries_by_continent": countries_by_continent,
    "countries_null_vs_empty": countries_null_vs_empty,
    "countries_topk_enum": countries_topk_enum,
    "countries_dim_join": countries_dim_join,
    "countries_digest": countries_digest,
    "countries_keys": countries_keys,
    "sql_gen_v6_invariants": _sql_invariants("gen_random_uuid_v6", V6),
    "sql_gen_v7_invariants": _sql_invariants("gen_random_uuid_v7", V7),
    "sql_gen_ksuid_s_invariants": _sql_invariants("gen_random_ksuid_second", KSUID),
    "sql_gen_ksuid_us_invariants": _sql_invariants("gen_random_ksuid_microsecond", KSUID),
    "sql_ts_from_v7_zones": sql_ts_from_v7_zones,
    "ids_by_hour": ids_by_hour,
    "countries_v1_upgrade": countries_v1_upgrade,
    "countries_constraints": countries_constraints,
    "extension_catalog": extension_catalog,
    "extension_versions": extension_versions,
}

_STAMPED = "stamped as (select event_id, epoch_us(ts) as us, md5(event_id::varchar) as r from events)"
_WORD = {
    "v7 spec": "((us // 1000) << 12) | ((us % 1000) << 2)",
    "v7 compat": "((((us + 500000) // 1000000) * 1000 + ((us % 1000000) + 500) // 1000) << 12) | ((us % 1000) << 2)",
    "v6 spec": "(us + 12219292800000000) * 10",
    "v6 compat": "((((us + 500000) // 1000000 + 12219292800)::double * 1e6 + (us % 1000000)) * 10)::bigint",
}


def _uuid_text(kind: str) -> str:
    return (
        f"substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-{kind[1]}' || substr(h, 13, 3) || '-' || "
        "substr('89ab', ('0x' || substr(r, 1, 1))::int % 4 + 1, 1) || substr(r, 2, 3) || '-' || substr(r, 5, 12)"
    )


def _uuid_twin(kind: str) -> str:
    return f"with {_STAMPED}, worded as (select event_id, r, lpad(lower(to_hex({_WORD[kind]})), 15, '0') as h from stamped) select event_id, {_uuid_text(kind)} as id from worded"


def _ksuid_twin(micro: bool, compat: bool) -> str:
    seconds = f"(us + {500000 * compat}) // 1000000 - {EPOCH}"
    tail = "lpad(lower(to_hex(us % 1000000)), 5, '0') || substr(r, 1, 27)" if micro else "substr(r, 1, 32)"
    limbs = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::ubigint as l{i}" for i in range(5))
    steps, last = [], "limbs0"
    for c in range(6):  # long division of the limbs by 62 ** 5
        named = f"select *, l0 % 916132832 as m0, l0 // 916132832 as q0 from {last}"
        for i in range(1, 5):
            named = f"select *, (m{i - 1} * 4294967296 + l{i}) % 916132832 as m{i}, (m{i - 1} * 4294967296 + l{i}) // 916132832 as q{i} from ({named})"
        keep = "".join(f", d{k}" for k in range(c))
        steps.append(f"limbs{c + 1} as (select event_id, {', '.join(f'q{i} as l{i}' for i in range(5))}, m4 as d{c}{keep} from ({named}))")
        last = f"limbs{c + 1}"
    digits = " || ".join(f"substr('{ALPHABET}', ((d{c} // {62**k}) % 62 + 1)::int, 1)" for c in range(5, -1, -1) for k in range(4, -1, -1))
    return f"with {_STAMPED}, hexed as (select event_id, lpad(lower(to_hex({seconds})), 8, '0') || {tail} as h from stamped), limbs0 as (select event_id, {limbs} from hexed), {', '.join(steps)} select event_id, right({digits}, 27) as id from {last}"


def _decode_twin(zone: str) -> str:
    local = "make_timestamp((us // 1000000) * 1000000)" + ("" if zone == "UTC" else f" at time zone 'UTC' at time zone '{zone}'")
    return f"with {_STAMPED} select event_id, {local} as ts from stamped"


def _constant(rows: list[tuple], names: str) -> str:
    return f"select * from (values {', '.join(str(r) if len(r) > 1 else f'({r[0]!r})' for r in rows)}) as t({names})"


#: Facts of the 249 rows, written out: rows and least code of each continent, their first three, and the continents of the first 25 codes.
_CONTINENTS = """('Africa', 58, 'AGO', 1), ('Antarctica', 5, 'ATA', 2), ('Asia', 50, 'AFG', 3), ('Europe', 45, 'ALB', 4), ('Oceania', 28, 'ASM', 5),
('North America', 36, 'ABW', 6), ('South America', 14, 'ARG', 7), (null, 13, 'ALA', null)"""
_FIRST_THREE = """('Africa', 1, 1, 'AGO', 'Angola'), ('Africa', 1, 2, 'BDI', 'Burundi'), ('Africa', 1, 3, 'BEN', 'Benin'), ('Antarctica', 2, 1, 'ATA', 'Antarctica'),
('Antarctica', 2, 2, 'ATF', 'French Southern Territories'), ('Antarctica', 2, 3, 'BVT', 'Bouvet Island'), ('Asia', 3, 1, 'AFG', 'Afghanistan'),
('Asia', 3, 2, 'ARE', 'United Arab Emirates'), ('Asia', 3, 3, 'ARM', 'Armenia'), ('Europe', 4, 1, 'ALB', 'Albania'), ('Europe', 4, 2, 'AND', 'Andorra'),
('Europe', 4, 3, 'AUT', 'Austria'), ('Oceania', 5, 1, 'ASM', 'American Samoa'), ('Oceania', 5, 2, 'AUS', 'Australia'), ('Oceania', 5, 3, 'CCK', 'Cocos (Keeling) Islands'),
('North America', 6, 1, 'ABW', 'Aruba'), ('North America', 6, 2, 'AIA', 'Anguilla'), ('North America', 6, 3, 'ATG', 'Antigua and Barbuda'),
('South America', 7, 1, 'ARG', 'Argentina'), ('South America', 7, 2, 'BOL', 'Bolivia'), ('South America', 7, 3, 'BRA', 'Brazil'),
(null, null, 1, 'ALA', 'Åland Islands'), (null, null, 2, 'BES', 'Bonaire, Sint Eustatius and Saba'), (null, null, 3, 'BLM', 'Saint Barthélemy')"""
_OF_FIRST_25 = """['North America', 'Asia', 'Africa', 'North America', null, 'Europe', 'Europe', 'Asia', 'South America', 'Asia', 'Oceania', 'Antarctica', 'Antarctica',
'North America', 'Oceania', 'Europe', 'Asia', 'Africa', 'Europe', 'Africa', null, 'Africa', 'Asia', 'Europe', 'Asia']"""

_ONE_EACH = "select count(*)::bigint as n, count(*)::bigint as n_distinct, true as all_match from events"

ORACLES: dict[str, str] = {
    "is_even_orders": "select coalesce(o_orderkey::int % 2 = 0, false) as even, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1",
    "is_odd_orders": "select not coalesce(o_orderkey::int % 2 = 0, false) as odd, o_orderstatus, count(*) as n, min(o_orderkey::int) as least from orders group by 1, 2",
    "parity_nulls": "select v, coalesce(v % 2 = 0, false) as even, not coalesce(v % 2 = 0, false) as odd, count(*) as n from (select nullif(l_linenumber, 3) as v from lineitem) group by 1, 2, 3",
    "parity_filter_join": "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey where o_orderkey % 2 = 0 and c_custkey % 2 <> 0 group by 1",
    "uuid_v7_at_events": _uuid_twin("v7 spec"),
    "uuid_v7_at_compat": _uuid_twin("v7 compat"),
    "uuid_v6_at_events": _uuid_twin("v6 spec"),
    "uuid_v6_at_compat": _uuid_twin("v6 compat"),
    "ksuid_second_at_events": _ksuid_twin(False, False),
    "ksuid_micro_at_events": _ksuid_twin(True, False),
    "ksuid_second_at_compat": _ksuid_twin(False, True),
    "ksuid_micro_at_compat": _ksuid_twin(True, True),
    "base62_roundtrip": "select count(*)::bigint as n, count(distinct o_orderkey)::bigint as n_distinct, true as same from orders",
    "ts_from_v7_utc": _decode_twin("UTC"),
    "ts_from_v7_paris": _decode_twin("Europe/Paris"),
    "ts_from_v7_newyork": _decode_twin("America/New_York"),
    "ts_from_v7_null_args": f"with {_STAMPED} select event_id, case when event_id % 2 = 0 then make_timestamp((us // 1000000) * 1000000) end as ts, null::timestamp as ts_no_zone from stamped",
    "gen_v6_invariants": _ONE_EACH,
    "gen_v7_invariants": _ONE_EACH,
    "gen_ksuid_s_invariants": _ONE_EACH,
    "gen_ksuid_us_invariants": _ONE_EACH,
    "id_order_window": "select count(*)::bigint as n, 0::bigint as inversions_v6, 0::bigint as inversions_v7 from events",
    "countries_by_continent": f"select continent, n::bigint as n, first_iso3, ordinal::bigint as ordinal from (values {_CONTINENTS}) as t(continent, n, first_iso3, ordinal)",
    "countries_null_vs_empty": "select 249::bigint as n, 13::bigint as n_null, 1::bigint as n_empty",
    "countries_topk_enum": f"select continent, ordinal::bigint as ordinal, rank::int as rank, iso3, name from (values {_FIRST_THREE}) as t(continent, ordinal, rank, iso3, name)",
    "countries_dim_join": f"select ({_OF_FIRST_25})[c_nationkey + 1] as continent, count(*) as n, round(sum(c_acctbal), 2) as balance from customer where c_nationkey between 0 and 24 group by 1",
    "countries_digest": "select * from (values ('0.0.2', 249::bigint, '56e5ba17e74fc1d70a1a18902413107a'), ('0.0.1', 249::bigint, 'eb1660955c9f1564fbaa5c1cb285cd14')) as t(version, n, digest)",
    "countries_keys": "select * from (values ('0.0.1', true, 249::bigint, 249::bigint, 0::bigint), ('0.0.2', false, 249::bigint, 249::bigint, 0::bigint)) as t(version, nullable, n, n_keys, n_null)",
    "sql_gen_v6_invariants": _ONE_EACH,
    "sql_gen_v7_invariants": _ONE_EACH,
    "sql_gen_ksuid_s_invariants": _ONE_EACH,
    "sql_gen_ksuid_us_invariants": _ONE_EACH,
    "sql_ts_from_v7_zones": f"""with {_STAMPED}, utc as (select event_id, make_timestamp((us // 1000000) * 1000000) as t from stamped)
select event_id, case event_id % 6 when 0 then t when 5 then t - interval 330 minute
  else t at time zone 'UTC' at time zone (['Europe/Paris', 'America/Port-au-Prince', 'Etc/GMT+5', 'Asia/Kolkata'])[(event_id % 6)::int] end as ts from utc""",
    "ids_by_hour": f"with {_STAMPED} select strftime(date_trunc('hour', make_timestamp((us // 1000000) * 1000000)), '%Y-%m-%d %H:%M') as start, count(*) as n from stamped group by 1",
    "countries_v1_upgrade": "select * from (values ('only in 0.0.1', 0::bigint), ('only in 0.0.2', 0::bigint)) as t(difference, n)",
    "countries_constraints": "select * from (values ('not null: iso3', 0::bigint), ('not null: iso2', 0::bigint), ('domain: continent', 0::bigint), ('key: iso3', 0::bigint)) as t(\"constraint\", violations)",
    "extension_catalog": _constant([(e.name, e.default_version, e.comment) for e in EXTENSIONS.values()], "name, default_version, comment"),
    "extension_versions": "select name, version, superuser, comment from (" + _constant([(e.name, v, 0, e.comment) for e in EXTENSIONS.values() for v in e.versions], "name, version, s, comment") + ") cross join (select false as superuser)",
}

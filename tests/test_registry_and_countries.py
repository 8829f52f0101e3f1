import pytest
from pyspark.sql import functions as F

from orrery.operators import Registry, assert_valid, violations
from orrery.sources import CONTINENTS, continent_ordinal, countries, preview
from orrery.sources.countries import SCHEMAS, upgrade
from orrery.streaming import counts_by_time_of_id, with_id


def test_countries_shape_and_constraints(spark):
    df = countries(spark)
    assert df.columns == ["name", "iso2", "iso3", "local_name", "continent"]
    assert df.count() == 249 == df.select("iso3").distinct().count()
    assert violations(df, key=["iso3"], required=["iso2"], domains={"continent": CONTINENTS}).agg(F.sum("violations")).first()[0] == 0
    rows = {r.iso3: r for r in df.collect()}
    assert sum(r.continent is None for r in rows.values()) == sum(r.local_name is None for r in rows.values()) == 13 and sum(r.local_name == "" for r in rows.values()) == 1
    assert rows["ASM"].iso2 == "as" and rows["ROM"].name == "Romania" and rows["ALA"].continent is None and rows["PRK"].name == "Korea, Democratic People's Republic of"
    assert df.schema["name"].metadata["comment"] and "comment" not in df.schema["continent"].metadata
    assert preview(df, 10).count() == 10


def test_countries_versions(spark):
    old = countries(spark, "0.0.1")
    assert [r.id for r in old.orderBy("id").limit(3).collect()] == [1, 2, 3]
    new = upgrade(old)
    assert not new.schema["iso3"].nullable and new.schema["iso3"].metadata == old.schema["iso3"].metadata
    for bad in ("AFG", None):
        twice = old.withColumn("iso3", F.when(F.col("id") == 3, F.lit(bad)).otherwise(F.col("iso3")))
        with pytest.raises(ValueError, match="iso3"):
            upgrade(twice)
    assert [r.name for r in old.orderBy("id").limit(14).collect()][::13] == ["Bonaire, Sint Eustatius and Saba", "American Samoa"]
    assert upgrade(old).columns == countries(spark, "0.0.2").columns == SCHEMAS["0.0.2"].fieldNames()
    with pytest.raises(ValueError):
        countries(spark, "9")


def test_countries_from_a_table_of_the_callers(spark):
    given = spark.createDataFrame([("A", "as", "AAA", "", "Asia", 1), ("B", "BB", "BBB", None, None, 2)], "name string, iso2 string, iso3 string, local_name string, continent string, other int")
    df = countries(spark, source=given)
    assert [tuple(r) for r in df.orderBy("iso3").collect()] == [("A", "as", "AAA", "", "Asia"), ("B", "BB", "BBB", None, None)]
    with pytest.raises(ValueError):
        countries(spark, "0.0.1", source=given)


def test_countries_are_broadcast(spark):
    joined = spark.range(100_000).withColumn("iso2", F.when(F.col("id") % 2 == 0, "FR").otherwise("DE")).join(countries(spark), "iso2")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_continent_order(spark):
    df = spark.createDataFrame([(c,) for c in reversed(CONTINENTS)] + [(None,)], "c string").withColumn("k", continent_ordinal("c"))
    assert [r.c for r in df.where("c is not null").orderBy("k").collect()] == list(CONTINENTS)
    assert df.where("c is null").first().k is None
    with pytest.raises(Exception, match="invalid continent"):
        spark.createDataFrame([("Atlantis",)], "c string").select(continent_ordinal("c")).collect()


def test_violations_are_counted(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "z")], "k int, v string")
    found = {r.constraint: r.violations for r in violations(df, key=["k"], required=["v"], domains={"v": ("a",)}).collect()}
    assert found == {"not null: k": 1, "not null: v": 1, "domain: v": 1, "key: k": 1}
    with pytest.raises(ValueError, match="key: k"):
        assert_valid(df, key=["k"])


def test_registry_walks_versions(spark):
    r = Registry(spark)
    r.create_extension("identifiers", "0.0.1")
    assert spark.sql("select length(gen_random_uuid_v7())").first()[0] == 36
    with pytest.raises(Exception):
        spark.sql("select timestamp_from_uuid_v7('018b99e6-5a2d-78cc-89aa-4b29b940caa7')").collect()
    assert r.update_path("identifiers") == ["0.0.2", "0.0.3", "0.0.4"]
    r.update("identifiers")
    got = spark.sql("select timestamp_from_uuid_v7('018b99e6-5a2d-78cc-89aa-4b29b940caa7'), timestamp_from_uuid_v7('018b99e6-5a2d-78cc-89aa-4b29b940caa7', timezone => 'europe/paris')").first()
    assert [str(x) for x in got] == ["2023-11-04 10:34:52", "2023-11-04 11:34:52"]
    many = spark.sql("select gen_random_ksuid_second() a, gen_random_ksuid_microsecond() b, gen_random_uuid_v6() c, gen_random_uuid_v7() d from range(500)")
    rows = many.collect()
    assert all(len({row[k] for row in rows}) == 500 for k in range(4))
    with pytest.raises(ValueError, match="no update path"):
        r.update("identifiers", "0.0.1")
    with pytest.raises(ValueError, match="already exists"):
        r.create_extension("identifiers")
    r.create_extension("identifiers", if_not_exists=True)
    with pytest.raises(ValueError):
        r.create_extension("nonsense")
    r.reset()
    assert not r.installed


def test_an_older_version_leaves_nothing_of_a_newer_one(spark):
    Registry(spark).create_extension("identifiers", if_not_exists=True)  # as the queries do
    r = Registry(spark)
    r.create_extension("identifiers", "0.0.1")
    for gone in ("timestamp_from_uuid_v7('018b99e6-5a2d-78cc-89aa-4b29b940caa7')", "gen_random_ksuid_second()", "base62_encode('00')"):
        with pytest.raises(Exception, match="UNRESOLVED_ROUTINE"):
            spark.sql(f"select {gone}").collect()
    assert spark.sql("select length(gen_random_uuid_v7())").first()[0] == 36
    r.reset()


def test_registry_countries_and_parity(spark):
    r = Registry(spark)
    r.create_extension("countries", "0.0.1")
    assert "id" in spark.table("countries").columns
    r.update("countries")
    assert "id" not in spark.table("countries").columns
    assert [x.comment for x in spark.sql("describe countries").collect() if x.col_name == "iso3"] == ["ISO 3166-1 alpha-3 code."]
    r.create_extension("is_even")
    r.create_extension("is_odd")
    assert tuple(spark.sql("select is_even(null), is_odd(null), is_even(-3), is_odd(-3)").first()) == (False, True, False, True)
    r.register_views()
    assert spark.table("available_extensions").count() == 4
    assert spark.table("available_extension_versions").count() == 8
    r.reset()


def test_ids_in_a_stream(spark):
    stream = spark.readStream.format("rate").option("rowsPerSecond", 200).load()
    query = with_id(stream, "uuid_v7").writeStream.format("memory").queryName("ids").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.sql("select count(*) n, count(distinct id) d from ids").first()
    assert got.n == got.d
    with pytest.raises(ValueError):
        with_id(spark.range(1), "nonsense")


def test_a_stream_counts_ids_by_their_own_time(spark, tmp_path):
    first, later = "018b99e6-5a2d-78cc-89aa-4b29b940caa", "018b99e8-5a2d-78cc-89aa-4b29b940caa"  # 2 minutes and 11 seconds apart
    schema = "id string"
    for k, ids in enumerate([[first + "1", first + "2", first + "1", None], [first + "2", later + "1"]]):
        spark.createDataFrame([(i,) for i in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = counts_by_time_of_id(stream).writeStream.outputMode("update").format("memory").queryName("by_minute").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {str(r.start): r.n for r in spark.sql("select start, max(n) n from by_minute group by start").collect()}
    assert got == {"2023-11-04 10:34:00": 2, "2023-11-04 10:37:00": 1}
    batch = spark.createDataFrame([(first + "1",), (first + "1",), (None,)], schema)
    assert [r.n for r in counts_by_time_of_id(batch).collect()] == [1]

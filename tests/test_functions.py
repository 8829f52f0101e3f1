import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from orrery.functions import base62_decode, base62_encode, canonical_zone, is_even, is_odd, timestamp_from_uuid_v7, uuid_normalized, uuid_v6_at, uuid_v7_at
from orrery.functions import ksuid_microsecond_at, ksuid_second_at, with_ksuid_microsecond, with_ksuid_second, with_uuid_v6, with_uuid_v7
from orrery.functions.ksuid import ALPHABET, EPOCH, decode_text, encode_hex

EDGES = [0, 499, 500, 999, 1000, 499_999, 500_000, 999_499, 999_500, 999_999]
BASE = 1_700_000_000_000_000
PAYLOAD = "9fcd208495d565ef0123456789abcdef"


def model_uuid(us, payload, version, mode):
    s = (us + 500_000) // 1_000_000 if mode == "compat" else us // 1_000_000
    if version == 7:
        ms = s * 1000 + ((us % 1_000_000) + 500) // 1000 if mode == "compat" else us // 1000
        word = (ms << 12) | ((us % 1000) << 2)
    elif mode == "compat":
        word = int((float(s + 12_219_292_800) * 1e6 + us % 1_000_000) * 10.0)
    else:
        word = (us + 12_219_292_800_000_000) * 10
    h = f"{word:015x}"
    return f"{h[:8]}-{h[8:12]}-{version}{h[12:]}-{'89ab'[int(payload[0], 16) % 4]}{payload[1:4]}-{payload[4:16]}"


@pytest.mark.parametrize("value,even", [(2, True), (0, True), (3, False), (-3, False), (-2147483648, True), (2147483647, False), (None, False)])
def test_parity(spark, value, even):
    df = spark.createDataFrame([(value,)], "v int")
    assert tuple(df.select(is_even("v"), is_odd("v")).first()) == (even, not even)


@pytest.mark.parametrize("version,make", [(6, uuid_v6_at), (7, uuid_v7_at)])
@pytest.mark.parametrize("mode", ["spec", "compat"])
def test_uuid_constructors_equal_the_model(spark, version, make, mode):
    rows = [(BASE + e, PAYLOAD) for e in EDGES]
    got = [r[0] for r in spark.createDataFrame(rows, "us long, r string").select(make("us", "r", mode)).collect()]
    assert got == [model_uuid(us, r, version, mode) for us, r in rows]


def test_spec_ids_sort_by_time_and_compat_ids_do_not(spark):
    df = spark.range(3000).select((F.lit(BASE) + F.col("id") * 137).alias("us"), F.lit(PAYLOAD).alias("r"))
    for make, mode, ordered in ((uuid_v7_at, "spec", True), (uuid_v6_at, "spec", True), (uuid_v7_at, "compat", False)):
        ids = [r[0] for r in df.orderBy("us").select(make("us", "r", mode)).collect()]
        assert (ids == sorted(ids)) is ordered


@pytest.mark.parametrize(
    "make,pattern",
    [
        (with_uuid_v6, "[0-9a-f]{8}-[0-9a-f]{4}-6[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"),
        (with_uuid_v7, "[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"),
        (with_ksuid_second, "[0-9A-Za-z]{27}"),
        (with_ksuid_microsecond, "[0-9A-Za-z]{27}"),
    ],
)
def test_generators(spark, make, pattern):
    ids = [r.id for r in make(spark.range(2000).withColumnRenamed("id", "k"), "id").collect()]
    assert len(set(ids)) == 2000
    assert all(re.fullmatch(pattern, i) for i in ids)


def test_generated_time_is_the_clock(spark):
    before = datetime.now(UTC).replace(tzinfo=None, microsecond=0)
    got = with_uuid_v7(spark.range(50)).select(timestamp_from_uuid_v7("id").alias("t")).agg(F.min("t"), F.max("t")).first()
    assert before <= got[0] <= got[1] <= datetime.now(UTC).replace(tzinfo=None)


def test_base62_golden_and_round_trip(spark):
    golden = {"0" * 40: "0" * 27, f"{1:040x}": "0" * 26 + "1", f"{61:040x}": "0" * 26 + "z", f"{62:040x}": "0" * 25 + "10", "f" * 40: "aWgEPTl1tmebfsQzFP4bxwgy80V"}
    assert encode_hex(list(golden)) == list(golden.values())
    assert decode_text(list(golden.values())) == list(golden)
    df = spark.createDataFrame([(k,) for k in golden] + [(None,)], "h string")
    coded = df.withColumn("t", base62_encode("h")).withColumn("back", base62_decode("t"))
    assert all(r.h == r.back and (r.t is None) == (r.h is None) for r in coded.collect())


def test_ksuid_layout(spark):
    def decoded(text):
        n = 0
        for c in text:
            n = n * 62 + ALPHABET.index(c)
        return n

    assert decoded("2HiFBj6X9oGTDYLDVn8qqfjfE9C") >> 128 == 268_759_863
    assert (decoded("2HiFJOmkJQ0tyawHfJwUJO9IomG") >> 108) & 0xFFFFF == 338_380
    df = spark.createDataFrame([(BASE + 123_456, PAYLOAD)], "us long, r string")
    second, micro = df.select(ksuid_second_at("us", "r"), ksuid_microsecond_at("us", "r")).first()
    assert decoded(second) == ((BASE // 1_000_000 - EPOCH) << 128) | int(PAYLOAD, 16)
    assert decoded(micro) == ((BASE // 1_000_000 - EPOCH) << 128) | (123_456 << 108) | int(PAYLOAD[:27], 16)


def test_ksuid_before_its_epoch_is_an_error(spark):
    df = spark.createDataFrame([(0, PAYLOAD)], "us long, r string")
    with pytest.raises(Exception, match="outside of the range"):
        df.select(ksuid_second_at("us", "r")).collect()


GOLDEN = "018b99e6-5a2d-78cc-89aa-4b29b940caa7"


@pytest.mark.parametrize(
    "zone,expected",
    [
        ("UTC", "2023-11-04 10:34:52"), ("Europe/Paris", "2023-11-04 11:34:52"), ("europe/paris", "2023-11-04 11:34:52"), ("America/New_York", "2023-11-04 06:34:52"),
        ("EST", "2023-11-04 05:34:52"), ("PST", "2023-11-04 02:34:52"), ("+05:30", "2023-11-04 05:04:52"), ("UTC+3", "2023-11-04 07:34:52"),
    ],
)
def test_decoder_zones(spark, zone, expected):
    df = spark.createDataFrame([(GOLDEN,)], "u string")
    for session_zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        try:
            assert str(df.select(timestamp_from_uuid_v7("u", zone)).first()[0]) == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_decoder_spellings_nulls_and_errors(spark):
    df = spark.createDataFrame([(GOLDEN.upper(),), ("{" + GOLDEN + "}",), (GOLDEN.replace("-", ""),)], "u string")
    assert {str(r[0]) for r in df.select(timestamp_from_uuid_v7("u")).collect()} == {"2023-11-04 10:34:52"}
    assert {r[0] for r in df.select(uuid_normalized("u")).collect()} == {GOLDEN}
    none = spark.createDataFrame([(None,)], "u string")
    assert none.select(timestamp_from_uuid_v7("u")).first()[0] is None
    assert df.select(timestamp_from_uuid_v7("u", None)).first()[0] is None
    with pytest.raises(ValueError):
        canonical_zone("Nope/Zone")
    with pytest.raises(Exception, match="invalid uuid"):
        spark.createDataFrame([("nonsense",)], "u string").select(timestamp_from_uuid_v7("u")).collect()

"""Versioned extensions of a Spark session: functions and views that come and go together.

An extension has a default version and a path of upgrades between versions. Creating it
registers the objects of that version in the session; updating it walks the path; dropping
it removes them. Nothing runs on executors until a query uses the objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import ksuid
from ..functions.clock import NOW_MICROS_SQL, RANDOM_HEX_SQL
from ..functions.identifiers import uuid_sql
from ..functions.predicates import IS_EVEN_SQL, IS_ODD_SQL
from ..functions.timestamps import decode_sql, zone_sql
from ..sources.countries import CONTINENTS, countries
from .constraints import assert_valid


def _function(name: str, arguments: str, returns: str, body: str, volatile: bool = False) -> Callable[[SparkSession], None]:
    kind = "not deterministic" if volatile else "deterministic"
    return lambda spark: spark.sql(f"create or replace temporary function {name}({arguments}) returns {returns} {kind} return {body}")


def _encoder(spark: SparkSession) -> None:
    spark.udf.register("base62_encode", ksuid.base62_encode)
    spark.udf.register("base62_decode", ksuid.base62_decode)


def _countries(version: str) -> Callable[[SparkSession], None]:
    def create(spark: SparkSession) -> None:
        df = countries(spark, version)
        key = ["id"] if version == "0.0.1" else ["iso3"]
        assert_valid(df, key=key, required=["iso2"], domains={"continent": CONTINENTS}).createOrReplaceTempView("countries")

    return create


#: Arguments reach a function as projected columns, so the constructors see one clock and one payload.
_PAYLOAD = f"concat({RANDOM_HEX_SQL.format(u='u')}, {RANDOM_HEX_SQL.format(u='v')})"
_U = "replace(uuid(), '-', '')"

OBJECTS: dict[str, Callable[[SparkSession], None]] = {
    "is_even": _function("is_even", "value int", "boolean", IS_EVEN_SQL.format(value="value")),
    "is_odd": _function("is_odd", "value int", "boolean", IS_ODD_SQL.format(value="value")),
    "random_hex": _function("random_hex", "u string, v string", "string", _PAYLOAD),
    "uuid_v6_at": _function("uuid_v6_at", "us bigint, payload string", "string", uuid_sql(6, "spec", "us", "payload")),
    "uuid_v7_at": _function("uuid_v7_at", "us bigint, payload string", "string", uuid_sql(7, "spec", "us", "payload")),
    "gen_random_uuid_v6": _function("gen_random_uuid_v6", "", "string", f"uuid_v6_at({NOW_MICROS_SQL}, random_hex({_U}, {_U}))", True),
    "gen_random_uuid_v7": _function("gen_random_uuid_v7", "", "string", f"uuid_v7_at({NOW_MICROS_SQL}, random_hex({_U}, {_U}))", True),
    "base62": _encoder,
    "ksuid_second_at": _function("ksuid_second_at", "us bigint, payload string", "string", f"base62_encode({ksuid.second_hex_sql('us', 'payload')})"),
    "ksuid_microsecond_at": _function("ksuid_microsecond_at", "us bigint, payload string", "string", f"base62_encode({ksuid.microsecond_hex_sql('us', 'payload')})"),
    "gen_random_ksuid_second": _function("gen_random_ksuid_second", "", "string", f"ksuid_second_at({NOW_MICROS_SQL}, random_hex({_U}, {_U}))", True),
    "gen_random_ksuid_microsecond": _function("gen_random_ksuid_microsecond", "", "string", f"ksuid_microsecond_at({NOW_MICROS_SQL}, random_hex({_U}, {_U}))", True),
    "timestamp_from_uuid_v7": _function("timestamp_from_uuid_v7", "uuid_v7 string, timezone string default 'UTC'", "timestamp_ntz", decode_sql("uuid_v7", zone_sql("timezone"))),
    "countries 0.0.1": _countries("0.0.1"),
    "countries 0.0.2": _countries("0.0.2"),
}


@dataclass(frozen=True)
class Extension:
    name: str
    comment: str
    versions: dict[str, tuple[str, ...]]
    """Objects by version; each version upgrades to the next."""
    superuser: bool = False

    @property
    def default_version(self) -> str:
        return list(self.versions)[-1]


_V6_V7 = ("random_hex", "uuid_v6_at", "uuid_v7_at", "gen_random_uuid_v6", "gen_random_uuid_v7")
_KSUID = ("base62", "ksuid_second_at", "ksuid_microsecond_at", "gen_random_ksuid_second", "gen_random_ksuid_microsecond")
_ALL = (*_V6_V7, *_KSUID, "timestamp_from_uuid_v7")

EXTENSIONS = {
    e.name: e
    for e in (
        Extension("identifiers", "Time-ordered identifiers", {"0.0.1": _V6_V7, "0.0.2": (*_V6_V7, *_KSUID), "0.0.3": _ALL, "0.0.4": _ALL}),
        Extension("countries", "Countries with their codes and continents", {"0.0.1": ("countries 0.0.1",), "0.0.2": ("countries 0.0.2",)}),
        Extension("is_even", "Tells whether a number is even", {"0.0.1": ("is_even",)}),
        Extension("is_odd", "Tells whether a number is odd", {"0.0.1": ("is_odd",)}),
    )
}


@dataclass
class Registry:
    spark: SparkSession
    installed: dict[str, str] = field(default_factory=dict)

    def _known(self, name: str, version: str | None = None) -> Extension:
        if name not in EXTENSIONS:
            raise ValueError(f"extension {name} is not available")
        if version is not None and version not in EXTENSIONS[name].versions:
            raise ValueError(f"extension {name} has no version {version}")
        return EXTENSIONS[name]

    def create_extension(self, name: str, version: str | None = None, if_not_exists: bool = False) -> None:
        extension = self._known(name, version)
        if name in self.installed:
            if if_not_exists:
                return
            raise ValueError(f"extension {name} already exists")
        version = version or extension.default_version
        # another registry of the session may have left objects of another version
        self._remove({key: None for keys in extension.versions.values() for key in keys if key not in extension.versions[version]})
        for key in extension.versions[version]:
            OBJECTS[key](self.spark)
        self.installed[name] = version

    def update_path(self, name: str, to: str | None = None) -> list[str]:
        """Versions to pass on the way from the installed one; there is no way back."""
        extension = self._known(name, to)
        if name not in self.installed:
            raise ValueError(f"extension {name} does not exist")
        versions = list(extension.versions)
        start, end = versions.index(self.installed[name]), versions.index(to or extension.default_version)
        if end < start:
            raise ValueError(f"extension {name} has no update path from {versions[start]} to {versions[end]}")
        return versions[start + 1 : end + 1]

    def update(self, name: str, to: str | None = None) -> None:
        for version in self.update_path(name, to):
            before = EXTENSIONS[name].versions[self.installed[name]]
            for key in EXTENSIONS[name].versions[version]:
                if key not in before:
                    OBJECTS[key](self.spark)
            self.installed[name] = version

    def drop(self, name: str) -> None:
        self._known(name)
        self._remove(EXTENSIONS[name].versions[self.installed.pop(name)])

    def _remove(self, keys: Iterable[str]) -> None:
        for key in keys:
            for each in ("base62_encode", "base62_decode") if key == "base62" else (key,):
                if each.startswith("countries "):
                    self.spark.catalog.dropTempView("countries")
                else:
                    self.spark.sql(f"drop temporary function if exists {each}")

    def install_all(self) -> None:
        for name in EXTENSIONS:
            self.create_extension(name, if_not_exists=True)

    def reset(self) -> None:
        for name in list(self.installed):
            self.drop(name)

    def available_extensions(self) -> DataFrame:
        rows = ", ".join(f"('{e.name}', '{e.default_version}', '{e.comment}')" for e in EXTENSIONS.values())
        return self.spark.sql(f"select * from values {rows} as t(name, default_version, comment)")

    def available_extension_versions(self) -> DataFrame:
        rows = ", ".join(f"('{e.name}', '{v}', {str(e.superuser).lower()}, '{e.comment}')" for e in EXTENSIONS.values() for v in e.versions)
        return self.spark.sql(f"select * from values {rows} as t(name, version, superuser, comment)")

    def register_views(self) -> None:
        self.available_extensions().createOrReplaceTempView("available_extensions")
        self.available_extension_versions().createOrReplaceTempView("available_extension_versions")

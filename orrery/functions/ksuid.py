"""KSUIDs: 160 bits, time first, as 27 digits in base 62 whose byte order is the order of time.

Spark has no 160-bit number, so the digits come from an Arrow function that divides five
32-bit limbs of a whole batch at once. All else is built-in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clock import with_clock

#: Digits of base 62 in ASCII order, and the second that counts as 0 (2014-05-13T16:53:20Z).
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
EPOCH = 1_400_000_000

WIDTH = 27
_LIMBS = 5
_CHUNK = 5  # digits that one division yields: 62 ** 5 < 2 ** 30, so limb and remainder fit 64 bits
_BYTES = np.frombuffer(ALPHABET.encode(), np.uint8)


def encode_hex(values: list[str]) -> list[str]:
    """Base 62 of numbers given as 40 hex digits."""
    limbs = np.frombuffer(bytes.fromhex("".join(values)), ">u4").reshape(-1, _LIMBS).astype(np.uint64)
    chunks = -(-WIDTH // _CHUNK)
    digits = np.zeros((len(limbs), chunks * _CHUNK), np.int64)
    base = np.uint64(62**_CHUNK)
    for c in range(chunks - 1, -1, -1):
        rest = np.zeros(len(limbs), np.uint64)
        for i in range(_LIMBS):
            here = (rest << np.uint64(32)) | limbs[:, i]
            limbs[:, i], rest = here // base, here % base
        rest = rest.astype(np.int64)
        for d in range(_CHUNK - 1, -1, -1):
            rest, digits[:, c * _CHUNK + d] = np.divmod(rest, 62)
    text = _BYTES[digits[:, -WIDTH:]].tobytes().decode()
    return [text[k : k + WIDTH] for k in range(0, len(text), WIDTH)]


def decode_text(values: list[str]) -> list[str]:
    """40 hex digits of numbers given as 27 digits of base 62."""
    place = np.full(256, 255, np.uint64)
    place[_BYTES] = np.arange(62)
    digits = place[np.frombuffer("".join(values).encode(), np.uint8).reshape(-1, WIDTH)]
    if (digits > 61).any():
        raise ValueError("a KSUID has a character outside of base 62")
    limbs = np.zeros((len(values), _LIMBS), np.uint64)
    for k in range(WIDTH):
        carry = digits[:, k]
        for i in range(_LIMBS - 1, -1, -1):
            here = limbs[:, i] * np.uint64(62) + carry
            limbs[:, i], carry = here & np.uint64(0xFFFFFFFF), here >> np.uint64(32)
        if carry.any():
            raise ValueError("a KSUID has more than 160 bits")
    text = limbs.astype(">u4").tobytes().hex()
    return [text[k : k + 40] for k in range(0, len(text), 40)]


def _filled(values: pa.Array, work) -> pa.Array:
    """Applies `work` to the values that are not null."""
    plain = values.to_pylist()
    found = iter(work([v for v in plain if v is not None]) if values.null_count < len(values) else [])
    return pa.array([None if v is None else next(found) for v in plain], pa.string())


@F.arrow_udf(T.StringType())
def base62_encode(values: pa.Array) -> pa.Array:
    return _filled(values, encode_hex)


@F.arrow_udf(T.StringType())
def base62_decode(values: pa.Array) -> pa.Array:
    return _filled(values, decode_text)


def _seconds(us: str, mode: str) -> str:
    whole = f"(({us}) + 500000) div 1000000" if mode == "compat" else f"({us}) div 1000000"
    return f"({whole} - {EPOCH})"


def second_hex_sql(us: str, payload: str, mode: str = "spec") -> str:
    """40 hex digits: 32 bits of seconds, 128 bits of payload. Times outside of the 32 bits raise an error."""
    s = _seconds(us, mode)
    return f"if({s} between 0 and 4294967295 or {s} is null, concat(lower(lpad(hex({s}), 8, '0')), substr({payload}, 1, 32)), raise_error('time outside of the range of a KSUID'))"


def microsecond_hex_sql(us: str, payload: str, mode: str = "spec") -> str:
    """40 hex digits: 32 bits of seconds, 20 of microseconds, 108 of payload."""
    s = _seconds(us, mode)
    return (
        f"if({s} between 0 and 4294967295 or {s} is null, concat(lower(lpad(hex({s}), 8, '0')), lower(lpad(hex(({us}) % 1000000), 5, '0')), substr({payload}, 1, 27)), "
        "raise_error('time outside of the range of a KSUID'))"
    )


def ksuid_second_at(us: str, payload: str, mode: str = "spec") -> Column:
    """A KSUID from a column of microseconds since 1970 and a column of 32 hex digits."""
    return base62_encode(F.expr(second_hex_sql(f"`{us}`", f"`{payload}`", mode)))


def ksuid_microsecond_at(us: str, payload: str, mode: str = "spec") -> Column:
    """The same with microseconds, and a column of 27 hex digits or more."""
    return base62_encode(F.expr(microsecond_hex_sql(f"`{us}`", f"`{payload}`", mode)))


def _generated(df: DataFrame, name: str, make) -> DataFrame:
    return with_clock(df, "_us", "_hex").withColumn(name, make("_us", "_hex")).drop("_us", "_hex")


def with_ksuid_second(df: DataFrame, name: str = "id") -> DataFrame:
    """Adds a new KSUID to every row. Ids differ in every run: write them before use."""
    return _generated(df, name, ksuid_second_at)


def with_ksuid_microsecond(df: DataFrame, name: str = "id") -> DataFrame:
    """Adds a new KSUID with microseconds to every row."""
    return _generated(df, name, ksuid_microsecond_at)

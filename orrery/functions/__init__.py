"""Scalar functions: as columns of a DataFrame and, once registered, by name in SQL."""

from .identifiers import uuid_normalized, uuid_v6_at, uuid_v7_at, with_uuid_v6, with_uuid_v7
from .ksuid import base62_decode, base62_encode, ksuid_microsecond_at, ksuid_second_at, with_ksuid_microsecond, with_ksuid_second
from .predicates import is_even, is_odd
from .timestamps import canonical_zone, timestamp_from_uuid_v7

__all__ = [
    "base62_decode", "base62_encode", "canonical_zone", "is_even", "is_odd", "ksuid_microsecond_at", "ksuid_second_at", "timestamp_from_uuid_v7",
    "uuid_normalized", "uuid_v6_at", "uuid_v7_at", "with_ksuid_microsecond", "with_ksuid_second", "with_uuid_v6", "with_uuid_v7",
]

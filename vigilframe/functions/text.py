"""Small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def duration_hms(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def duration_hm(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    return F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s / 60) % 60)


def hash_bucket(value: Column, buckets: int = 1000) -> Column:
    """A stable bucket 0..buckets-1 for a text (first 32 bits of its digest)."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint") % buckets


def hash_fraction(value: Column) -> Column:
    """Number as is; other text becomes a stable fraction 0..1."""
    return F.coalesce(value.try_cast("double"), hash_bucket(value) / 1000)


def fixed(value: Column, digits: int) -> Column:
    """The number with so many decimals, rounded from its exact binary value, ties to even, as C's printf does.

    ``format_string`` rounds the shortest decimal text half up instead: 90.35 (below the tie) becomes 90.4.
    """
    x = value.cast("double")
    pattern = "0." + "0" * digits if digits else "0"
    known = F.call_function("format_number", x, F.lit(pattern))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNotNull(), F.coalesce(odd, known))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed(value, digits), F.lit("%"))

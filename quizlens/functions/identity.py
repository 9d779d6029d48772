"""Ids from content and the leak-free partition into training and test items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import TEST_FRACTION


def stable_hash(c: Column) -> Column:
    """The first 32 bits of the MD5 of the value as text, 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def item_id(question: Column, given: Column | None = None) -> Column:
    made = F.md5(F.coalesce(question, F.lit("")))
    return made if given is None else F.coalesce(F.nullif(given, F.lit("")), made)


def threshold(fraction: float) -> int:
    """Buckets of a thousand that are test buckets; truncated, on the driver."""
    return int(fraction * 1000)


def bucket(item: Column) -> Column:
    return F.pmod(stable_hash(item), F.lit(1000)).cast("int")


def is_test(item: Column, fraction: float = TEST_FRACTION) -> Column:
    return bucket(item) < threshold(fraction)

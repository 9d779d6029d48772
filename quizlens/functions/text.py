"""Words, sentences and blanks by one definition of white space, the same in Java's and RE2's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as str.split() and str.strip() take it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def has_text(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(c.rlike(NOT_SPACE), F.lit(False))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Parts between full stops, stripped, without blanks; decimals are parted too."""
    return F.filter(F.transform(F.split(c, r"\."), strip), lambda x: x != "")


#: A word with its inner apostrophes, points and hyphens, or a mark by itself.
LINGUISTIC = r"[\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def linguistic_tokens(c: Column) -> Column:
    """Words apart from marks, for taggers; features of words take white-space tokens instead."""
    return F.regexp_extract_all(c, F.lit(LINGUISTIC), 0)


def preview(c: Column, n: int = 80) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def whole_percent(done: Column, total: Column) -> Column:
    return F.lit(100.0) * done / F.greatest(total, F.lit(1))

"""Positions in a total order without any task having a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive values of the second key that one task numbers.
BLOCK = 65_536


def numbered(df: DataFrame, group: str, first: str, second: str, name: str = "position") -> DataFrame:
    """Adds the 0-based position within ``group`` by (first, second).

    ``first`` is a hash in hexadecimal, so its beginning spreads a group evenly; ``second`` is a dense number without
    repeats, so a block of it bounds the rows that share one ``first``. Counts of blocks are added up, not rows.
    """
    part = F.substring(first, 1, 3)
    df = df.withColumn("_block", F.floor(F.col(second) / BLOCK).cast("long"))
    keys = [group, first, "_block"]
    blocks = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_part", part)
    parts = blocks.groupBy(group, "_part").agg(F.sum("_n").alias("_n"))  # at most 4096 a group
    before = parts.select(group, "_part", (F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_earlier"))
    within = F.sum("_n").over(Window.partitionBy(group, "_part").orderBy(first, "_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = blocks.withColumn("_within", within).join(before, [group, "_part"]).select(*keys, (F.col("_earlier") + F.col("_within")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(second)) - 1
    return df.withColumn("_own", own).join(offsets, keys).withColumn(name, (F.col("_offset") + F.col("_own")).cast("long")).drop("_block", "_own", "_offset")


def chunked(df: DataFrame, group: str, first: str, second: str, size: int) -> DataFrame:
    """Adds ``position`` and ``chunk``, runs of ``size`` rows in order."""
    return numbered(df, group, first, second).withColumn("chunk", F.floor(F.col("position") / size).cast("long"))

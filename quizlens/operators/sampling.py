"""Samples without replacement, a number of rows for each group.

Keyed: the rows with the smallest MD5 of seed and key; needs no order and survives restarts; Spark keeps at most
``n`` rows a group and partition before it shuffles. Indexed: the very rows that Python's ``random.Random(seed).sample`` picks by
position, for results that must equal those drawn by it.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import SEED


def keyed(df: DataFrame, group: str, n: int, *key: str, seed: int = SEED) -> DataFrame:
    """Adds ``draw``, the rank of each of the rows drawn."""
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    by = Window.partitionBy(group).orderBy("_ticket", *key)
    return df.withColumn("_ticket", ticket).withColumn("draw", F.row_number().over(by)).where(F.col("draw") <= n).drop("_ticket")


def indices(total: int, n: int, seed: int = SEED) -> list[int]:
    """Positions in the order drawn; all of them in order where there are no more than ``n``."""
    return random.Random(seed).sample(range(total), n) if total > n else list(range(total))


def capped(df: DataFrame, group: str, position: str, n: int, seed: int = SEED) -> DataFrame:
    """``indexed`` with ``place``: groups above ``n`` in the order drawn, others in their own order."""
    return indexed(df, group, position, n, seed).withColumnRenamed("draw", "place")


def resorted(df: DataFrame, group: str, position: str, n: int, seed: int = SEED) -> DataFrame:
    """``indexed`` with ``place``: the sample in its own order again, whatever order it was drawn in."""
    drawn = indexed(df, group, position, n, seed).drop("draw")  # at most ``n`` rows a group
    return drawn.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(position)).cast("long") - 1)


def indexed(df: DataFrame, group: str, position: str, n: int, seed: int = SEED) -> DataFrame:
    """Rows whose dense position is drawn, with ``draw``, the order in which it was; each group has a generator of its own.

    The driver holds ``n`` numbers a group.
    """
    totals = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()}
    drawn = [(g, p, k) for g, total in totals.items() for k, p in enumerate(indices(total, n, seed))]
    picked = df.sparkSession.createDataFrame(drawn, f"`{group}` {df.schema[group].dataType.simpleString()}, `{position}` long, draw long")
    return df.join(picked, [group, position])

"""Options of items: the right one, the others, one row each, and back again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import answer_index
from ..functions.text import has_text


def with_gold(items: DataFrame) -> DataFrame:
    """Adds gold_at (place of the right option), gold and distractors (the others in order; null without a right one)."""
    at = answer_index(F.col("answer"), F.col("options"))
    out = items.withColumn("gold_at", at)
    return out.withColumn("gold", F.get("options", F.col("gold_at"))).withColumn("distractors", F.when(F.col("gold_at").isNotNull(), F.filter("options", lambda o, i: i != F.col("gold_at"))))


def valid_distractors(c: Column | str = "distractors") -> Column:
    return F.filter(c, has_text)


def exploded(items: DataFrame, *keep: str) -> DataFrame:
    """One row for each usable option of items with a right answer: option_idx 0 and label 1 for the right one, 1 to n
    and label 0 for the others in order, blanks included in the numbering but not in the rows."""
    rows = with_gold(items).where("gold_at is not null").select(*keep, "gold_at", F.posexplode("options").alias("place", "text"))
    idx = F.when(F.col("place") == F.col("gold_at"), 0).when(F.col("place") < F.col("gold_at"), F.col("place") + 1).otherwise(F.col("place"))
    return rows.where(has_text(F.col("text"))).select(*keep, idx.cast("int").alias("option_idx"), (idx == 0).cast("int").alias("label"), "text")


def reassembled(items: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Options with those of ``new`` (key, place, new_text) put in their places; the rest stay, order stays."""
    found = new.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "new_text"))).alias("found"))  # an item's own options
    swapped = F.transform("options", lambda o, i: F.coalesce(F.try_element_at(F.col("found"), i), o))
    return items.join(found, key, "left").withColumn("options", F.when(F.col("found").isNull(), F.col("options")).otherwise(swapped)).drop("found")


def renewed(items: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Options with ``change`` applied to each that is not blank, in place, without a shuffle."""
    return items.withColumn("options", F.transform("options", lambda o: F.when(has_text(o), F.coalesce(change(o), o)).otherwise(o)))

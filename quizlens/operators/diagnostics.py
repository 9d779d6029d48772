"""What completions look like, and whether two policies or their files are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import first_letter
from ..functions.text import has_text


def profile(rows: DataFrame, *group: str, text: str = "text") -> DataFrame:
    """``group``, n, empty_or_whitespace, contains_valid_letter."""
    c = F.col(text)
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(~has_text(c)).alias("empty_or_whitespace"), F.count_if(first_letter(c).isNotNull()).alias("contains_valid_letter"))


def first_characters(rows: DataFrame, *group: str, text: str = "text") -> DataFrame:
    """``group``, first_char, n."""
    return rows.where(F.length(text) > 0).groupBy(*group, F.left(text, F.lit(1)).alias("first_char")).agg(F.count("*").alias("n"))


def first_character_map(rows: DataFrame, *group: str, text: str = "text") -> DataFrame:
    return first_characters(rows, *group, text=text).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("first_char", "n"))).alias("first_char_distribution"))


#: Characters of a prompt that a diagnosis shows.
PROMPT_PREVIEW = 300


def prompt_preview(prompt: Column) -> Column:
    return F.left(prompt, F.lit(PROMPT_PREVIEW))


def side_by_side(completions: DataFrame, *key: str) -> DataFrame:
    """``key``, treatment_raw, control_raw, identical_output of each prompt that either policy answered."""
    of = lambda g: F.max(F.when(F.col("grp") == g, F.col("completion"))).alias(f"{g}_raw")
    return completions.groupBy(*key).agg(of("treatment"), of("control")).withColumn("identical_output", F.col("treatment_raw").eqNullSafe(F.col("control_raw")))


def ratio(same: Column, n: Column) -> Column:
    return F.concat(same.cast("string"), F.lit("/"), n.cast("string"))


def agreement(pairs: DataFrame, *group: str) -> DataFrame:
    rows = pairs.groupBy(*group).agg(F.count_if("identical_output").alias("same"), F.count("*").alias("n"))
    return rows.withColumn("identical_outputs", ratio(F.col("same"), F.col("n")))


def same_files(files: DataFrame) -> DataFrame:
    """file, md5 of files that both groups hold with equal contents."""
    t, c = (files.where(F.col("grp") == g).select("file", "md5") for g in ("treatment", "control"))
    return t.intersect(c)

"""Scores of completions: accuracy overall and by domain in one pass, and exploitation gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import reward

NAN = float("nan")


def accuracy(scored: DataFrame, completion: str = "completion", correct: str = "correct_letter") -> DataFrame:
    """grp, variant, domain (null: overall), n, n_correct, accuracy; a completion without a letter is wrong, not missing."""
    rows = scored.select("grp", "variant", "domain", reward(F.col(completion), F.col(correct)).cast("long").alias("r"))
    sets = rows.groupingSets([[F.col("grp"), F.col("variant")], [F.col("grp"), F.col("variant"), F.col("domain")]], F.col("grp"), F.col("variant"), F.col("domain"))
    return sets.agg(F.count("*").alias("n"), F.sum("r").alias("n_correct")).withColumn("accuracy", F.col("n_correct") / F.col("n"))


def wide(acc: DataFrame) -> DataFrame:
    """grp, domain with a column a variant; NaN where a variant has no such domain."""
    of = lambda v: F.coalesce(F.max(F.when(F.col("variant") == v, F.col("accuracy"))), F.lit(NAN)).alias(v)
    return acc.groupBy("grp", "domain").agg(of("original"), of("neutralized"), of("adversarial"))


def gaps(acc: DataFrame) -> DataFrame:
    """grp, domain (null: overall), gap: neutralized minus adversarial accuracy."""
    return wide(acc).select("grp", "domain", (F.col("neutralized") - F.col("adversarial")).alias("gap"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error that says what is empty."""
    if df.isEmpty():
        raise RuntimeError(f"no rows: {what}")
    return df


def require_all(**frames: DataFrame) -> dict[str, DataFrame]:
    """All frames, or an error that names each one that is empty."""
    empty = [name for name, df in frames.items() if df.isEmpty()]
    if empty:
        raise RuntimeError(f"no rows: {', '.join(empty)}")
    return frames


def empty_domains(df: DataFrame, domains: tuple[str, ...], domain: str = "domain") -> list[str]:
    """The domains without a row, to be warned about; a flag for each of the given domains reaches the driver."""
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(domain) == d), F.lit(False)).alias(d) for d in domains]).first()
    return [d for d in domains if not flags[d]]

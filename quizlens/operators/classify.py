"""Separability of two classes by scores: exact rank-sum AUROC, and two trained classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cuts of the scores of a group; they only deal out work, the result is exact for any.
CUTS = 200


def auroc(scored: DataFrame, *group: str, score: str = "score", label: str = "label") -> DataFrame:
    """``group``, auroc, n_samples: chance that a row of label 1 has the larger score, ties half; NaN without both labels.

    Equal scores are added up first. Their cumulative counts are taken within ranges of scores and over the ranges, so
    no task has all scores of a group. Rows with a null or NaN score do not count.
    """
    keys = list(group)
    rows = scored.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))
    same = rows.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    bounds = same.groupBy(*keys).agg(F.percentile_approx("s", [i / CUTS for i in range(1, CUTS)], 1000).alias("bounds"))
    same = same.join(bounds, keys).withColumn("part", F.size(F.filter("bounds", lambda b: b <= F.col("s")))).drop("bounds")
    below = F.sum("q").over(Window.partitionBy(*keys, "part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q")
    within = same.withColumn("below", below).groupBy(*keys, "part").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("wins"))
    earlier = F.sum("q").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q")
    total = within.withColumn("earlier", earlier).groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("wins") + F.col("p") * F.col("earlier")).alias("wins"))
    area = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q"))).otherwise(float("nan"))
    return total.select(*keys, area.alias("auroc"), (F.col("p") + F.col("q")).alias("n_samples"))


#: Of so many parts of the rows, by a hash of their key, one is scored and the others are learned from.
HELD_OUT = 5


def model_scores(table: DataFrame, features: tuple[str, ...], key: str, label: str = "label", model: str = "gbt", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, label and score of the held-out rows by a classifier fitted on the others; NaN features count as 0."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = table.where(F.col(label).isNotNull()).select(*keep, (F.pmod(F.crc32(F.col(key).cast("string")), F.lit(HELD_OUT)) == 0).alias("held_out"), F.col(label).cast("double").alias("label"), *[F.nanvl(F.coalesce(F.col(f), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
    ready = VectorAssembler(inputCols=list(features), outputCol="vector").transform(known).select(*keep, "held_out", "label", "vector").persist()
    try:
        kind = GBTClassifier(labelCol="label", featuresCol="vector", maxIter=10, maxDepth=3, seed=42) if model == "gbt" else LogisticRegression(labelCol="label", featuresCol="vector", maxIter=50)
        fitted = kind.fit(ready.where("not held_out"))
    finally:
        ready.unpersist()
    return fitted.transform(ready.where("held_out")).select(*keep, F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))

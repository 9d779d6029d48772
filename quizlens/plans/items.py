"""Multiple-choice items made of ``documents``, and scripted completions, for running the operators on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import DOMAINS, GROUPS
from ..functions.identity import bucket, is_test, item_id
from ..operators.mcq import paired, variants
from ..operators.options import renewed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_no, item_id, domain, question, options, answer: five documents are an item, the first its question."""
    place = F.pmod("doc_id", F.lit(5))
    texts = [F.max(F.when(place == k, F.col("text"))).alias(f"t{k}") for k in range(5)]
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 5).cast("long").alias("item_no")).agg(*texts)
    answer = F.chr((F.lit(65) + F.pmod(F.col("item_no") * 7 + 3, F.lit(5))).cast("int"))
    domain = F.get(F.array(*map(F.lit, DOMAINS)), F.pmod("item_no", F.lit(3)).cast("int"))
    options = F.filter(F.array("t1", "t2", "t3", "t4"), lambda x: x.isNotNull())
    return rows.select("item_no", item_id(F.col("t0")).alias("item_id"), domain.alias("domain"), F.col("t0").alias("question"), options.alias("options"), answer.alias("answer"))


def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumns({"bucket": bucket(F.col("item_id")), "is_test": is_test(F.col("item_id"))})


def neutral(rows: DataFrame) -> DataFrame:
    """Stands for a transformed control set: every option in lower case."""
    return renewed(rows, F.lower)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return paired(rows.where(is_test(F.col("item_id"))), neutral(rows))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_no, item_id, domain, variant, grp, correct_letter, prompt and a completion scripted by a hash."""
    rows = variants(pairs(spark, sf_dir)).withColumn("grp", F.explode(F.array(*map(F.lit, GROUPS))))
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", "item_id", "variant", "grp")), 1, 1), 16, 10).cast("int")
    said = F.when(digit <= 2, "<think>").when(digit <= 5, "B").when(digit <= 8, "Answer: C").when(digit <= 10, "0000").otherwise(F.col("correct_letter"))
    return rows.withColumn("completion", said)

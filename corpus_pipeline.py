"""A corpus pipeline over ``documents``: each stage calls one operator and works on all its predecessor kept.

Rows with null ids, empty texts, extra columns and repeated rows pass as each operator's docstring defines; stages that
drop documents decide on each row's own text, and only the near-duplicate stage compares rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlens.llm import decontaminate, packing, pii, simhash, toxicity
from quizlens.llm.common import documents, staged
from quizlens.llm.queries import tokenizer

#: Documents that score at least this are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not toxic; the labels are those that op8 may learn from."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.where(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts share at least 0.8 of their five-word shingles: the one of the smallest id."""
    keep = simhash.similar_groups(docs).where("keep").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_same"))
    joined = marked.join(keep, F.col("_own").eqNullSafe(F.col("_id")) & (marked["_same"] == keep["_same"]))
    return joined.select("row", "_own", marked["_same"]).dropDuplicates(["_own", "_same"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in 20 lies in a benchmark window."""
    scanned = decontaminate.summary(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return scanned.where("not contaminated").select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    masked = pii.mask(docs, carry=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    new = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text)).cast("long")}
    return masked.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal_data", mask_personal_data), ("packing", pack_sequences)]

#: Neither the classifier nor the field can be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

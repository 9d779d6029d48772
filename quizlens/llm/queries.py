"""The registered queries of this package, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, decontaminate, licenses, media, packing, pii, shards, simhash, sql, substring, toxicity
from .common import documents


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.summary(documents(spark, sf_dir), items)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(documents(spark, sf_dir))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_digests(dac.write(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(documents(spark, sf_dir)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (~toxicity.learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = media.write_archives(documents(spark, sf_dir))
    return media.media_features(media.read_archives(spark, folder))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(documents(spark, sf_dir)).drop("kept")


QUERIES = {"op10_substring": op10_substring, "op1_pii": op1_pii, "op3_shards": op3_shards, "op5_token_files": op5_token_files, "op6_packing": op6_packing, "op7_licenses": op7_licenses, "op8_toxicity": op8_toxicity, "op9_media": op9_media, "op2_decontaminate": op2_decontaminate, "op4_simhash": op4_simhash}
SQL: dict[str, str] = {"op2_decontaminate": sql.OP2, "op3_shards": sql.OP3, "op10_substring": sql.OP10}

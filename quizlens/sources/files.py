"""Corpora as JSON lines a domain, features as Parquet, reports as JSON, and fingerprints of files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..fixed import DOMAINS
from ..functions.identity import item_id

_LINE = StructType([StructField("value", StringType())])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems have the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def domain_paths(spark: SparkSession, folder: str, domains: tuple[str, ...] = DOMAINS) -> list[str]:
    return [p for d in domains if exists(spark, p := f"{folder.rstrip('/')}/{d}.jsonl")]


def _options(v) -> F.Column:
    """Elements of a JSON array that are strings, as strings, the others as null, so that places stay."""
    return F.transform(v, lambda o: F.when(F.schema_of_variant(o) == "STRING", o.cast("string")))


def read_items(spark: SparkSession, folder: str, domains: tuple[str, ...] = DOMAINS, strict: bool = True) -> DataFrame:
    """domain (the file's name), load_seq, item_id, question, options, answer of all domains present, in one scan.

    ``strict``: a line that is no JSON object fails the query; else it is left out. load_seq orders rows as the files
    do: by domain, then by Spark's row ids, which rise within a file, as its equal splits are dealt in order and its
    shorter last one after them.
    """
    paths = domain_paths(spark, folder, domains)
    if not paths:
        return spark.createDataFrame([], "domain string, load_seq long, item_id string, question string, options array<string>, answer string")
    rank = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    rows = spark.read.schema(_LINE).text(paths).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1).alias("domain"), F.monotonically_increasing_id().alias("_line")).where("trim(value) <> ''")
    parse = F.parse_json if strict else F.try_parse_json
    rows = rows.withColumn("v", parse("value")).where("v is not null")
    get = lambda field, kind: F.try_variant_get("v", f"$.{field}", kind)
    options = _options(F.coalesce(get("options", "array<variant>"), F.array().cast("array<variant>")))
    seq = rank.cast("long") * F.lit(1 << 58) + F.col("_line")
    return rows.select("domain", seq.alias("load_seq"), item_id(get("question", "string"), get("id", "string")).alias("item_id"), get("question", "string").alias("question"), options.alias("options"), get("answer", "string").alias("answer"))


def read_done(spark: SparkSession, folder: str) -> DataFrame:
    """item_id of rows that a control sink holds; undecodable lines, as a killed writer leaves, count as not written."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "item_id string")
    rows = spark.read.schema("id string").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(folder)
    return rows.where("id <> ''").select(F.col("id").alias("item_id")).distinct()


def append_control(rows: DataFrame, folder: str) -> None:
    """Append id, question, options, answer by domain; files appear when their task commits."""
    rows.select(F.col("item_id").alias("id"), "domain", "question", "options", "answer").write.mode("append").partitionBy("domain").option("ignoreNullFields", "false").json(folder)


def read_control(spark: SparkSession, folder: str) -> DataFrame:
    schema = StructType([StructField("id", StringType()), StructField("domain", StringType()), StructField("question", StringType())])
    return spark.read.schema(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ") + ", options array<string>, answer string").json(folder).withColumnRenamed("id", "item_id")


def write_features(table: DataFrame, folder: str) -> None:
    """One data set for all domains; a domain is a partition of it."""
    table.write.mode("overwrite").partitionBy("domain").parquet(folder)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def nested_report(acc: list[dict]) -> dict:
    """The evaluation report as nested dictionaries, from the rows of ``accuracy``."""
    out: dict = {}
    for r in acc:
        g = out.setdefault(r["grp"], {"overall": {}, "per_domain": {}})
        if r["domain"] is None:
            g["overall"][r["variant"]] = r["accuracy"]
        else:
            g["per_domain"].setdefault(r["variant"], {})[r["domain"]] = r["accuracy"]
    nan = float("nan")
    for g in out.values():
        n, a = (g["per_domain"].get(v, {}) for v in ("neutralized", "adversarial"))
        g["artifact_exploitation_gap"] = g["overall"].get("neutralized", nan) - g["overall"].get("adversarial", nan)
        g["artifact_exploitation_gap_by_domain"] = {d: n.get(d, nan) - a.get(d, nan) for d in sorted({*n, *a})}
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_report(spark: SparkSession, path: str, acc: list[dict]) -> None:
    write_text(spark, path, json.dumps(nested_report(acc), indent=2))


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file, md5, size_bytes of the files in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.md5("content").alias("md5"), F.col("length").cast(LongType()).alias("size_bytes"))

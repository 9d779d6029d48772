"""Shared plumbing: the shared scratch folder, staged tables, text access."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows handed to a worker's kernel at once; bounds a kernel's working set, not its input.
KERNEL_ROWS = 256
#: Rows in an Arrow batch between Spark and its workers.
BATCH_ROWS = 1_000
#: Characters handed to a worker's kernel at once (a single longer text goes alone).
KERNEL_CHARS = 1_000_000


def _is_local(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local master may do without that setting: a temporary folder then serves, and is removed with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{_own_folder()}"
    # with its scheme, so that Spark and the workers' own readers and writers mean the same place
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="quizlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def staged(df: DataFrame, label: str, frees: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and lost executors lose nothing.

    ``frees``: staged tables that nothing reads after this; their folders go. Tables that a result still reads stay
    until the process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    free(*frees)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    atexit.register(_remove, spark, path)
    return out


def free(*tables: DataFrame) -> None:
    for t in tables:
        _remove(t.sparkSession, t.staged_at)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; the folder may be gone
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on, so that a worker's share of a batch of long texts stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


_kept: dict[object, object] = {}


def workspace(key: object, make):
    """What ``make`` gives, kept in this worker until something else is asked for: stages that share a worker do not
    add up their memories."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def released() -> None:
    """Forget what earlier kernels have left in this worker; for kernels that keep nothing."""
    _kept.clear()


def narrow(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Only the id (as ``doc_id`` long) and the text (null: empty); other columns cannot clash with an operator's own.

    ``carry`` keeps the whole row beside them, as the struct ``row``.
    """
    bounded(df.sparkSession)
    kept = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *kept)


def extended(df: DataFrame, ddl: str) -> StructType:
    """``ddl``'s columns, and ``row`` where ``df`` carries it."""
    made = StructType.fromDDL(ddl)
    return StructType([*made.fields, *(f for f in df.schema.fields if f.name == "row")])


def carried(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``columns``, and the batch's ``row`` where it has one."""
    if "row" in batch.schema.names:
        columns = columns | {"row": batch["row"]}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def unsigned_crc32(c: Column) -> Column:
    return F.crc32(c).cast("long")


def kernel_slices(texts: list[str]):
    """Index ranges of at most KERNEL_ROWS texts and about KERNEL_CHARS characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= KERNEL_ROWS or size + len(t) > KERNEL_CHARS):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)

"""What the operators share: their tables, bounded Arrow batches, folds of ids."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components  # noqa: F401
from ..sources.scratch import drop, scratch, settle  # noqa: F401

#: Rows in one Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small in memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def release(frame: DataFrame) -> None:
    """Lets Spark delete the shuffle files of steps that are settled: it does when the driver's JVM finds their plans gone."""
    gc.collect()
    frame.sparkSession.sparkContext._jvm.System.gc()


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table has; a missing text or label column counts as null."""
    kinds = {"doc_id": "bigint", "vec_id": "bigint", "text": "string", "lang": "string"}
    return df.select(*(F.col(n).cast(kinds[n]).alias(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names))


def fold(column: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(0))

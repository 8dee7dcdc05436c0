"""Step tables in the folder that all executors share: they end lineage and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets one in its own local folder; a cluster has none
    that all executors see, so the setting is asked for."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.local.dir', '/tmp').rstrip('/')}/{spark.sparkContext.applicationId}-shared"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a compressed table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """The rows of a settled table dealt by keys over as many tasks as it has multiples of ``each``, so that a task's share stays as it is
    when the table grows; tasks are not put together again."""
    return rows.repartition(max(1, -(-rows.count() // each)), *keys)


def drop(*frames: DataFrame) -> None:
    """Deletes settled tables that nothing reads again, and lets Spark's cleaner find the shuffles that made them."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for file in df.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    frames[0].sparkSession.sparkContext._jvm.System.gc()

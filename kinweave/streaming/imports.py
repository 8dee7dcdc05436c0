"""Files that keep arriving, imported one after another: each sees the contacts that the ones before it made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import mapping, resolve
from ..sources import store


def follow(spark: SparkSession, rows: DataFrame, folder: str, checkpoint: str, now: Callable[[], str], source: str = "csv") -> StreamingQuery:
    """Starts a query that replays each micro-batch of rows (a stream with row_number and columns known to the mapping) against
    the last snapshot of contacts in folder and writes the next one. A batch that is run again after a failure finds its rows known."""
    columns = mapping.suggest([c for c in rows.columns if c != "row_number"]).mapping

    def take(batch: DataFrame, number: int) -> None:
        contacts = store.load(spark, folder, ["contacts"])["contacts"]
        outcomes = resolve.replay(contacts, mapping.map_rows(batch.withColumn("row_number", F.col("row_number").cast("long")), columns).drop("dropped"))
        store.save(spark, folder, {"contacts": resolve.applied(contacts, outcomes, now(), source)})

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()

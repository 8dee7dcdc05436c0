"""Keeps an indexed-text table, or an index of postings, in step with streams of changed items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators import postings
from ..operators.search import indexed_text


def refreshed(index: DataFrame, changed_ids: DataFrame, contacts: DataFrame, needs: DataFrame, offers: DataFrame) -> DataFrame:
    """The index with the rows of changed contacts rebuilt from the base tables; deleted contacts fall out."""
    ids = changed_ids.select("id").distinct()
    own = needs.join(ids.withColumnRenamed("id", "contact_id"), "contact_id", "left_semi"), offers.join(ids.withColumnRenamed("id", "contact_id"), "contact_id", "left_semi")
    fresh = indexed_text(contacts.join(ids, "id", "left_semi"), *own)
    return index.join(ids, "id", "left_anti").unionByName(fresh.select(index.columns))


def follow(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each batch's changed ids to ``apply``, which swaps the snapshot."""
    return changes.writeStream.foreachBatch(lambda batch, _: apply(batch.select("id").distinct())).option("checkpointLocation", checkpoint)


def follow_postings(spark: SparkSession, changes: DataFrame, path: str, corpus: Callable[[], DataFrame], checkpoint: str) -> DataStreamWriter:
    """A writer that refreshes the index of postings in path with each batch's changed ids (id): their rows of the corpus as it is then
    replace earlier versions, and ids that it lacks are deleted. A batch that is run again after a failure changes nothing more."""

    def take(batch: DataFrame, _: int) -> None:
        ids = batch.select("id").distinct()
        rows = corpus()
        postings.refresh(postings.opened(spark, path), rows.join(ids, "id", "left_semi"), ids.join(rows.select("id"), "id", "left_anti"))

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)

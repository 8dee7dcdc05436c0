"""Row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import drop, settle

#: Rows of a range: as many ranges as that takes, so that a task sorts as much of a large table as of a small one.
RANGE = 500_000


def _dealt(rows: DataFrame, *keys: Column) -> tuple[DataFrame, int]:
    """rows in ranges of keys (_range), and how many ranges."""
    laid = settle(rows, "laid")
    n = max(1, -(-laid.count() // RANGE))
    dealt = settle(laid.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    drop(laid)
    return dealt, n


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "position", within: Sequence[str] = ()) -> DataFrame:
    """rows with their place, from 1, in ``order``; per value of ``within`` where that is given.

    Rows are dealt into ranges of within and order, numbered there, and moved by what the ranges before them hold.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*within, *order]]
    dealt, n = _dealt(rows, *keys)
    counts = dealt.groupBy("_range", *within).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = counts.select("_range", *(F.col(c).alias(f"_{c}") for c in within), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    here = F.row_number().over(W.partitionBy("_range", *within).orderBy(*order))
    on = F.col("_range") == F.col("_at")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # Only what a range begins with can have begun in an earlier one: a row a range, at most.
    moved = F.broadcast(offsets.where("_offset > 0").withColumnRenamed("_range", "_at"))
    placed = dealt.repartition(n, "_range", *within).withColumn("_here", here).join(moved, on, "left")
    return placed.select(*rows.columns, (F.col("_here") + F.coalesce("_offset", F.lit(0))).cast("long").alias(name))


def running_least(rows: DataFrame, key: str, order: str, value: str, name: str = "least") -> DataFrame:
    """rows with the least value of the rows of the same key that come strictly earlier in order; null where there is none.

    Rows are dealt into ranges of key and order, so a key of any size is spread over them: each range takes its own running minimum,
    and only a key that began before a range is moved by what its earlier ranges hold. Rows with a null value only ask. A null key
    is a key of its own; rows of equal order do not see each other.
    """
    dealt, n = _dealt(rows, F.col(key), F.col(order))
    each = dealt.groupBy("_range", F.col(key).alias("_key")).agg(F.min(value).alias("_m"))
    before = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    moved = F.broadcast(each.select(F.col("_range").alias("_at"), "_key", F.min("_m").over(before).alias("_earlier")).where("_earlier is not null"))
    here = F.min(value).over(W.partitionBy("_range", key).orderBy(order).rangeBetween(W.unboundedPreceding, -1))
    placed = dealt.repartition(n, "_range", key).withColumn("_here", here).join(moved, (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return placed.select(*rows.columns, F.least("_here", "_earlier").alias(name))

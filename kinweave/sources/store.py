"""Snapshots of named tables as Parquet with a catalog of versions, JSON lines and database tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import catalog
from .scratch import settle


class Conflict(RuntimeError):
    """A table changed since it was read."""


def load(spark: SparkSession, folder: str, names: Sequence[str] | None = None, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the latest snapshot, or of the one with that number; all, or those named. KeyError for a name it lacks."""
    tables = catalog.latest(spark, folder)[1] if number is None else catalog.read(spark, folder, number)
    return {n: spark.read.parquet(f"{folder}/{tables[n]}") for n in (tables if names is None else names)}


def version(spark: SparkSession, folder: str) -> int:
    """The latest snapshot's number, 0 before the first."""
    return catalog.latest(spark, folder)[0]


def _written(folder: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    paths = {n: f"data/{n}-{uuid.uuid4().hex}.parquet" for n in tables}
    for n, df in tables.items():
        df.write.parquet(f"{folder}/{paths[n]}")
    return paths


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], based_on: int | None = None, read: Sequence[str] = ()) -> int:
    """Makes the next snapshot: these tables in place of the old ones, all others as they are. Gives its number.

    Readers see the old snapshot or the new one. based_on is the snapshot that the tables were made from: Conflict if one of them, or
    of the tables in ``read``, has changed since then. Writers of different tables do not disturb each other. Without based_on, the
    last writer of a table wins.
    """
    paths = _written(folder, tables)
    base = {} if not based_on else catalog.read(spark, folder, based_on)
    while True:
        number, now = catalog.latest(spark, folder)
        changed = [n for n in {*tables, *read} if now.get(n) != base.get(n)] if based_on is not None else []
        if changed:
            raise Conflict(f"changed since snapshot {based_on}: {', '.join(sorted(changed))}")
        if catalog.commit(spark, folder, number + 1, now | paths):
            return number + 1


def change(spark: SparkSession, folder: str, names: Sequence[str], apply: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 10) -> int:
    """Applies a change to the named tables, again on the newer ones where another writer came first; Conflict after so many tries.

    apply takes the tables and gives those that it changed. Its result must come from what it is handed, as it may run more than once.
    """
    for _ in range(tries):
        number = version(spark, folder)
        try:
            return save(spark, folder, apply(load(spark, folder, names, number)), number, names)
        except Conflict:
            continue
    raise Conflict(f"other writers came first {tries} times")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_json_lines(rows: DataFrame, path: str) -> None:
    """Rewrites all lines, also where rows come from these: new files first, then the old ones go."""
    settle(rows, "lines").write.mode("overwrite").json(path)


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table behind JDBC; partition options split the read over executors."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def append_database(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()

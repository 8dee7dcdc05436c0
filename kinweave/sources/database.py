"""Insert-or-return-existing into a database table: tasks stage rows, one transaction inserts those of the tasks that counted.

Written against Python's database interface, so any driver does; ``connect`` names a function, as ``module:name``, that takes the url
and gives a connection. A task that runs again stages its rows under a name of its own, and only the names that Spark hands to the
commit are inserted, so no row is written twice.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, StructField, StructType

from .scratch import settle

#: Rows sent to the database at once.
BATCH = 1000


@dataclass
class _Part(WriterCommitMessage):
    name: str


def _connection(options: dict):
    module, _, name = options["connect"].partition(":")
    return getattr(importlib.import_module(module), name)(options["url"])


class _Tables:
    """Statements about one run's tables. Names and the key come from the caller's code, values always go as parameters."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        self.table, self.stage, self.mark = options["table"], options["stage"], options.get("mark", "?")
        self.key, self.where = options["key"], options.get("where")

    def open(self) -> None:
        listed = ", ".join(self.columns)
        with _Open(self.options) as cursor:
            cursor.execute(f"create table {self.stage} as select {listed}, cast('' as varchar(80)) as part_, 0 as seq_ from {self.table} where 1 = 0")
            cursor.execute(f"create table {self.stage}_parts (part_ varchar(80))")

    def commit(self, parts: list[str]) -> None:
        """In one transaction: what was known before, then the insert; the first of several rows of a key wins."""
        listed, where = ", ".join(self.columns), f" where {self.where}" if self.where else ""
        with _Open(self.options) as cursor:
            cursor.executemany(f"insert into {self.stage}_parts (part_) values ({self.mark})", [(p,) for p in parts])
            cursor.execute(f"delete from {self.stage} where part_ not in (select part_ from {self.stage}_parts)")
            # The conflict target may be an expression; staged rows get theirs under a name.
            cursor.execute(f"create table {self.stage}_keys as select {self.key} as key_, part_, seq_ from {self.stage}{where}")
            cursor.execute(f"create table {self.stage}_known as select distinct {self.key} as key_ from {self.table}{where}{' and' if where else ' where'} {self.key} in (select key_ from {self.stage}_keys)")
            cursor.execute(f"insert into {self.table} ({listed}) select {listed} from {self.stage}{where or ' where 1 = 1'} order by seq_, part_ on conflict ({self.key}){where} do nothing")

    def drop(self) -> None:
        with _Open(self.options) as cursor:
            for suffix in ("", "_parts", "_keys", "_known"):
                cursor.execute(f"drop table if exists {self.stage}{suffix}")


class _Open:
    """A cursor whose work is committed at the end, or rolled back."""

    def __init__(self, options: dict):
        self.connection = _connection(options)

    def __enter__(self):
        return self.connection.cursor()

    def __exit__(self, fault, *_) -> None:
        try:
            self.connection.rollback() if fault else self.connection.commit()
        finally:
            self.connection.close()


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.tables, self.columns = _Tables(options, [c for c in columns if c != "seq_"]), columns

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        part, marks = uuid.uuid4().hex, ", ".join([self.tables.mark] * (len(self.columns) + 1))
        statement = f"insert into {self.tables.stage} ({', '.join(self.columns)}, part_) values ({marks})"
        with _Open(self.tables.options) as cursor:
            rows = []
            for row in iterator:
                rows.append((*row, part))
                if len(rows) == BATCH:
                    cursor.executemany(statement, rows)
                    rows = []
            if rows:
                cursor.executemany(statement, rows)
        return _Part(part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.tables.commit([m.name for m in messages if m])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.tables.drop()


@dataclass
class _Piece(InputPartition):
    name: str


class _Reader(DataSourceReader):
    """The staged rows' stored rows: a partition for each task that wrote."""

    def __init__(self, options: dict, columns: list[str]):
        self.tables, self.columns = _Tables(options, []), [c for c in columns if c != "duplicate"]

    def partitions(self) -> list[InputPartition]:
        with _Open(self.tables.options) as cursor:
            cursor.execute(f"select part_ from {self.tables.stage}_parts")
            return [_Piece(r[0]) for r in cursor.fetchall()]

    def read(self, partition: _Piece) -> Iterator[tuple]:
        t = self.tables
        stored = ", ".join(c if c == "seq_" else f"t.{c}" for c in self.columns)
        first = f"select key_, min(seq_) as first_ from {t.stage}_keys group by key_"
        own = f"select {t.key} as key_, {t.table}.* from {t.table}" + (f" where {t.where}" if t.where else "")
        with _Open(t.options) as cursor:
            cursor.execute(
                f"select {stored.replace('seq_', 's.seq_')}, case when k.key_ is not null or s.seq_ > f.first_ then 1 else 0 end from {t.stage}_keys s join ({own}) t on t.key_ = s.key_ "
                f"join ({first}) f on f.key_ = s.key_ left join {t.stage}_known k on k.key_ = s.key_ where s.part_ = {t.mark}", (partition.name,)
            )
            while rows := cursor.fetchmany(BATCH):
                for *values, duplicate in rows:
                    yield (*values, bool(duplicate))


class UpsertSource(DataSource):
    """The data source behind ``upsert``."""

    @classmethod
    def name(cls) -> str:
        return "staged_upsert"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema.names)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema.names)


def upsert(spark: SparkSession, rows: DataFrame, connect: str, url: str, table: str, key: str, order: str, stored: str, where: str | None = None, mark: str = "?") -> DataFrame:
    """Inserts rows whose key the table does not have. Gives, for each row, its order, the stored row's columns, and ``duplicate``:
    whether the key was known before, or from a row earlier in order.

    key is a column or an expression that the table has a unique index on, over the rows that ``where`` holds for; rows for which it does
    not hold are left out. order is a column of different longs, which is not stored; stored says which columns of the table come
    back, with types. mark is the driver's sign for a parameter. Two runs at once are told apart by the index: each key is inserted once.
    """
    columns = [c for c in rows.columns if c != order]
    options = {"connect": connect, "url": url, "table": table, "stage": f"stage_{uuid.uuid4().hex}", "key": key, "mark": mark} | ({"where": where} if where else {})
    tables = _Tables(options, columns)
    spark.dataSource.register(UpsertSource)
    tables.open()
    try:
        rows.select(*columns, F.col(order).cast("long").alias("seq_")).write.format("staged_upsert").options(**options).mode("append").save()
        kinds = spark.createDataFrame([], stored).schema
        schema = StructType([StructField("seq_", rows.select(F.col(order).cast("long")).schema[0].dataType), *kinds, StructField("duplicate", BooleanType())])
        return settle(spark.read.format("staged_upsert").options(**options).schema(schema).load().withColumnRenamed("seq_", order), "upserted")
    finally:
        tables.drop()

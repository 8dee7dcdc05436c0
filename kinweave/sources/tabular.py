"""Tabular files whose format, encoding, delimiter and header row are found; Spark reads them in splits."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import records, workbook

#: Lines that decide the delimiter, rows among which a header is looked for, and the largest workbook in bytes.
HEAD_LINES, HEADER_ROWS, MAX_WORKBOOK = 300, 15, 20_000_000
#: The extensions of an upload.
EXTENSIONS = (".csv", ".xlsx", ".xls")
_DELIMITERS = (",", ";", "\t", "|")
_number = re.compile(r"^[+-]?\d+(?:[.,]\d+)?$")


def byte_order(head: bytes) -> str | None:
    """UTF-16 with its byte order, from the mark a file begins with."""
    return {b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}.get(head[:2])


def format_of(name: str, head: bytes) -> str:
    """csv or xlsx. A workbook under a text file's name and the old binary workbooks raise ValueError; text under a workbook's name is csv."""
    if head[:4] == b"\xd0\xcf\x11\xe0":
        raise ValueError(f"{name}: binary workbooks of the old kind are not read; save it as xlsx or csv")
    if head[:2] == b"PK":
        if name.lower().endswith((".csv", ".txt", ".tsv")):
            raise ValueError(f"{name}: this is a workbook")
        return "xlsx"
    return "csv"


def is_header(cells: Sequence[str]) -> bool:
    """Two filled cells or more, none long or a number, half with a letter, and mostly different."""
    filled = [c.strip() for c in cells if c and c.strip()]
    if len(filled) < 2 or any(len(c) > 60 or _number.match(c) for c in filled):
        return False
    different = len({c.lower() for c in filled})
    return 2 * sum(any(x.isalpha() for x in c) for c in filled) >= len(filled) and different >= 2 and 3 * different >= 2 * len(filled)


def is_header_column(cells: Column) -> Column:
    """The same rule over an array column."""
    filled = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    n, different = F.size(filled), F.size(F.array_distinct(F.transform(filled, F.lower)))
    letters = F.size(F.filter(filled, lambda c: c.rlike(r"\p{L}")))
    bad = F.exists(filled, lambda c: (F.char_length(c) > 60) | c.rlike(r"^[+-]?[0-9]+([.,][0-9]+)?$"))
    return (n >= 2) & ~bad & (2 * letters >= n) & (different >= 2) & (3 * different >= 2 * n)


def header_at(grid: Sequence[Sequence[str]]) -> int:
    """The first of the first 15 rows with a cell "first name", else the first that looks like a header."""
    top = list(grid[:HEADER_ROWS])
    for rule in (lambda r: any("first name" in (c or "").lower() for c in r), is_header):
        for k, row in enumerate(top):
            if rule(row):
                return k
    raise ValueError("no header row found")


def unique_names(cells: Sequence[str], width: int) -> list[str]:
    """Cleaned header names; repeated ones get (2), (3), unnamed ones their number."""
    names: list[str] = []
    for k in range(width):
        name = re.sub(r"\s+", " ", re.sub(r'^"(.*)"$', r"\1", (cells[k] if k < len(cells) else "" or "").replace("﻿", "").strip())).strip() or f"Spalte {k + 1}"
        n, base = 2, name
        while name in names:
            name, n = f"{base} ({n})", n + 1
        names.append(name)
    return names


def read(spark: SparkSession, path: str, sheet: str | int | None = None) -> tuple[DataFrame, list[str]]:
    """(rows as text columns with row_number from 1, warnings). Blank rows are left out, missing cells are empty, and so are columns
    without a name and without a value in any row.

    The encoding is UTF-16 with a byte order mark, else UTF-8 if every line of the file is, else windows-1252, with a warning. ValueError
    for a file without a header row, a workbook under a text file's name or the other way round beyond what a warning can say.
    """
    warnings: list[str] = []
    begin = spark.read.text(path).select(F.col("value").cast("binary").alias("v")).limit(1).collect()
    kind = format_of(path, bytes(begin[0].v[:8]) if begin else b"")
    if kind == "xlsx":
        file = spark.read.format("binaryFile").load(path)
        if file.agg(F.max("length")).first()[0] > MAX_WORKBOOK:
            raise ValueError("the workbook is too large")
        table = file.select("content").mapInPandas(lambda frames: workbook.rows(frames, sheet), "number long, cells array<string>")
        grid = [r.cells for r in table.orderBy("number").limit(HEADER_ROWS).collect()]
    else:
        order = byte_order(bytes(begin[0].v[:2]) if begin else b"")
        separator = {None: "\n", "UTF-16LE": "\n\0", "UTF-16BE": "\0\n"}[order]
        lines = spark.read.option("lineSep", separator).text(path)
        bad = F.col("value").cast("binary")
        guess = not order and bool(lines.agg(F.bool_or(~F.is_valid_utf8(F.col("value")))).first()[0])
        code = order or ("windows-1252" if guess else "UTF-8")
        if guess:
            warnings.append("encoding guessed: windows-1252")
        if path.lower().endswith((".xlsx", ".xls")):
            warnings.append("a text file under a workbook's name")
        head = separator.encode().join(bytes(r.v) for r in lines.select(bad.alias("v")).limit(HEAD_LINES).collect())
        text = records.decoded(head, code).lstrip("\ufeff")
        delimiter = max(_DELIMITERS, key=lambda d: (_steadiness(text, d), -_DELIMITERS.index(d)))
        csv.field_size_limit(2**31 - 1)
        grid = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r][:HEADER_ROWS]
        # Where no quoted cell holds a line break, lines are records and Spark's own reader takes them. A line of blanks alone is a
        # record, which that reader would leave out.
        plain = not order and lines.where((F.regexp_count("value", F.lit('"')) % 2 == 1) | F.col("value").rlike(r"^[\x00-\x20]+$") | F.col("value").rlike("\r.")).isEmpty()
        table = _by_spark(spark, path, grid, delimiter, guess) if plain else records.cut(lines, code, separator.encode(), delimiter)
        if table is None:  # a block of the file begins within a character
            table = _whole(spark, path, code, delimiter)
    start = header_at(grid)
    body = table.where(F.col("number") > start)
    filled = body.where(F.exists("cells", lambda c: F.trim(c) != ""))
    width = max(len(grid[start]), body.agg(F.max(F.size("cells"))).first()[0] or 0)
    names = unique_names(grid[start], width)
    unnamed = [k for k in range(width) if not (grid[start][k] if k < len(grid[start]) else "").replace("\ufeff", "").strip(' \t"')]
    used = filled.agg(*(F.bool_or(F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit(""))) != "").alias(f"u{k}") for k in unnamed)).first() if unnamed else ()
    kept = [k for k in range(width) if k not in {k for k, u in zip(unnamed, used, strict=True) if not u}]
    return filled.select((F.col("number") - start).alias("row_number"), *(F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(names[k]) for k in kept)), warnings


def check_upload(spark: SparkSession, path: str, most: int = MAX_WORKBOOK) -> int:
    """The size of an uploaded file in bytes; ValueError for an empty or too large one, or an extension that is not read."""
    name = path.rsplit("/", 1)[-1]
    extension = f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""
    if extension not in EXTENSIONS:
        raise ValueError(f"files with the extension {extension or name} are not read; {', '.join(EXTENSIONS)} are")
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(file).getLen()
    if not size:
        raise ValueError("the file is empty")
    if size > most:
        raise ValueError(f"the file is larger than {most} bytes")
    return size


def _by_spark(spark: SparkSession, path: str, grid: list, delimiter: str, guess: bool) -> DataFrame:
    """number, cells of a file whose lines are records."""
    # Spark reads no windows-1252: as Latin-1 only bytes 80 to 9F differ, and those are put right afterwards.
    wrong, right = zip(*((chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")), strict=True)
    cell = lambda k: F.translate(F.col(f"c{k}"), "".join(wrong), "".join(right)) if guess else F.col(f"c{k}")
    options = {"sep": delimiter, "encoding": "ISO-8859-1" if guess else "UTF-8", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    width = _width(_csv(spark, path, max(map(len, grid), default=1), options, True), max(map(len, grid), default=1), delimiter)
    rows = _numbered(_csv(spark, path, width, options, False))
    return rows.select("number", F.array(*(F.coalesce(cell(k), F.lit("")) for k in range(width))).alias("cells"))


def _whole(spark: SparkSession, path: str, code: str, delimiter: str) -> DataFrame:
    """number, cells of a file read by one task."""

    def parsed(frames):
        csv.field_size_limit(2**31 - 1)
        for frame in frames:
            for content in frame["content"]:
                grid = [r for r in csv.reader(io.StringIO(records.decoded(content, code).lstrip("\ufeff"), newline=""), delimiter=delimiter) if r]
                yield pd.DataFrame({"number": range(len(grid)), "cells": grid})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, "number long, cells array<string>")


def _csv(spark: SparkSession, path: str, width: int, options: dict, broken: bool) -> DataFrame:
    """Columns c0 on, where broken also the text of records of another width, and where each row was read."""
    schema = ", ".join([*(f"c{k} string" for k in range(width)), *(["broken string"] if broken else [])])
    rows = spark.read.csv(path, schema=schema, columnNameOfCorruptRecord="broken", **options)
    return rows.select("*", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds number, from 0 in the file's order."""
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row a block of the file
    blocks = rows.groupBy("block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    shifts = blocks.select("block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(shifts), "block").withColumn("number", F.col("place") + F.col("shift"))


def _width(rows: DataFrame, width: int, delimiter: str) -> int:
    """The most cells of any row; those of another width than the schema's are counted in their text."""

    def counted(frames):
        csv.field_size_limit(2**31 - 1)
        for frame in frames:
            found = [len(r) for text in frame["broken"].dropna() for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)]
            yield pd.DataFrame({"width": [max(found, default=0)]})

    cells = [c for c in rows.columns if c not in ("block", "place")]
    return max(width, rows.select(*cells).mapInPandas(counted, "width long").agg(F.max("width")).first()[0] or 0)


def _steadiness(text: str, delimiter: str) -> int:
    """How many of the first rows have the most frequent width above one."""
    widths = [len(r) for r in list(csv.reader(io.StringIO(text), delimiter=delimiter))[: 2 * HEADER_ROWS]]
    wide = [w for w in widths if w > 1]
    return max((wide.count(w) * min(w, 3) for w in set(wide)), default=0)

"""Records of delimited text whose quoted cells hold line breaks, cut out of a file's lines in splits.

Whether a line begins a record depends on all quotes before it. So each block of the file is folded first, for both cases: beginning
outside a quoted cell, or within one. Folds compose, so one row a block gives each block its true beginning and its first record's
number. A second pass cuts records out of the blocks side by side; what crosses a block's end is put together by number.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The longest record, in characters: beyond it a quote was never closed.
LONGEST = 64_000_000

_close = re.compile(r'(?:[^"]|"")*+"')
_C1 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}


def decoded(text: bytes, code: str) -> str:
    """Text in an encoding; windows-1252 keeps its five bytes without a character as they are."""
    return text.decode("latin-1").translate(_C1) if code == "windows-1252" else text.decode(code, "replace")


def open_after(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted cell is still open at a line's end. A quote opens a cell only where the cell begins."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            found = _close.match(line, at if inside else at + 1)
            if not found:
                return True
            at, inside = found.end(), False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def _lines(batches: Iterator[pa.RecordBatch], code: str, separator: bytes) -> Iterator[tuple[int, str | None, dict]]:
    """(block, line, other columns); None for a line where a block ends within a character. In UTF-16 the separator's bytes may also
    stand across two characters: such a line goes on."""
    rest, block, row = None, None, {}
    for batch in batches:
        names = [n for n in batch.schema.names if n != "value"]
        for k, value in enumerate(batch.column("value")):
            row = {n: batch.column(n)[k].as_py() for n in names}
            if rest is not None and row["block"] != block:
                yield block, None, row
                rest = None
            block, bytes_ = row["block"], value.as_py()
            bytes_ = bytes_ if rest is None else rest + separator + bytes_
            rest = bytes_ if code.startswith("UTF-16") and len(bytes_) % 2 else None
            if rest is None:
                yield block, decoded(bytes_, code), row
    if rest is not None:
        yield block, None, row


def _parsed(text: str, delimiter: str) -> list[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return [r for r in csv.reader(io.StringIO(text.lstrip("﻿") if text.startswith("﻿") else text, newline=""), delimiter=delimiter) if r]


def _blank(line: str) -> bool:
    return line.lstrip("﻿") in ("", "\r")


def _count(line: str, delimiter: str) -> int:
    """Records that begin in a line outside quotes: one, none for an empty line, more only where a lone carriage return ends some."""
    return 0 if _blank(line) else 1 if "\r" not in line.rstrip("\r\n") or '"' in line else len(_parsed(line, delimiter))


def cut(lines: DataFrame, code: str, separator: bytes, delimiter: str) -> DataFrame | None:
    """number (from 0) and cells of the records; None if a block of the file begins within a character. Empty lines are no records.
    ValueError in the task for a record beyond ``LONGEST``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for block, line, _ in _lines(batches, code, separator):
            state = held.setdefault(block, [False, 0, True, 0, False])
            if line is None:
                state[4] = True
                continue
            for k in (0, 2):
                if not state[k]:
                    state[k + 1] += _count(line, delimiter)
                state[k] = open_after(line, delimiter, state[k])
        columns = [[b for b in held], *([s[k] for s in held.values()] for k in range(5))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()), strict=True)], names=["block", "out_open", "out_n", "in_open", "in_n", "torn"])

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds = pd.concat([f for f in frames] or [pd.DataFrame(columns=["block"])]).sort_values("block")
        inside, number, out = False, 0, []
        last = len(folds) - 1
        for k, f in enumerate(folds.itertuples(index=False)):
            out.append((f.block, inside, number, bool(f.torn) and k < last))
            inside, number = (f.in_open, number + f.in_n) if inside else (f.out_open, number + f.out_n)
        yield pd.DataFrame(out, columns=["block", "inside", "first", "torn"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("number", pa.int64()), ("cells", pa.list_(pa.string())), ("block", pa.int64()), ("part", pa.string())])
        rows: list[tuple] = []
        now = inside = None
        number, open_, size = 0, [], 0

        def left() -> None:  # a record that the block's end cuts
            if open_:
                rows.append((number, None, now, "\n".join(open_)))

        for block, line, row in _lines(batches, code, separator):
            if block != now:
                left()
                now, inside, open_, size = block, row["inside"], [], 0
                number = row["first"] - 1 if inside else row["first"]
                began = not inside  # whether the open record begins in this block
            if line is None:
                continue
            if not inside and not open_ and _blank(line):
                continue
            inside = open_after(line, delimiter, inside)
            open_.append(line)
            size += len(line)
            if size > LONGEST:
                raise ValueError(f"a record is longer than {LONGEST} characters: a quote is not closed")
            if not inside:
                text = "\n".join(open_)
                if began:
                    for cells in _parsed(text, delimiter):
                        rows.append((number, cells, None, None))
                        number += 1
                else:
                    rows.append((number, None, now, text))
                    number += 1
                open_, size, began = [], 0, True
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows.clear()
        left()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"number": frame["number"], "cells": [(_parsed(t, delimiter) or [[]])[0] for t in frame["text"]]})

    raw = lines.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    folds = raw.mapInArrow(fold, "block long, out_open boolean, out_n long, in_open boolean, in_n long, torn boolean")
    starts = folds.coalesce(1).mapInPandas(chain, "block long, inside boolean, first long, torn boolean")  # one row a block
    if not starts.where("torn").isEmpty():
        return None
    # The blocks' beginnings are one row for each block of the file; lines keep their order beside them.
    pieces = raw.join(F.broadcast(starts.drop("torn")), "block").mapInArrow(records, "number long, cells array<string>, block long, part string")
    parts = pieces.where("part is not null").groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "\n").alias("text"))  # a record's own pieces
    return pieces.where("part is null").select("number", "cells").unionByName(parts.mapInPandas(joined, "number long, cells array<string>"))

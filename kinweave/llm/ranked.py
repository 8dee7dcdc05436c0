"""Ranked lexical search: short lists are summed first, then stand as one list among the long ones while documents are skipped.

``index`` deals documents into segments and writes a row for each term of a segment: which of its documents hold the term, and
how often. No shuffle makes it, and a term in every document has as many rows as there are segments. ``search`` brings each segment's
postings of the asked terms together with the items. There, an item's short lists are materialised as summed accumulators. The sums
then act as one more list, with a bound for each block of documents as the long lists have; windows of blocks are taken in document
order, blocks whose bounds together stay below the tenth best score so far are skipped, and within the others documents go as soon as
what is left of their bounds cannot reach it. A task keeps each item's best ten over all its segments, so later ones skip more.

All arithmetic on scores is on 64-bit integers; only a term's weight is a floored logarithm in doubles.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base
from .terms import Terms

#: Postings and documents of a segment at most (a document's own terms may exceed the first), rows of a written Arrow batch.
POSTINGS, DOCUMENTS, WRITTEN = 1_000_000, 65_536, 20_000
#: Documents in a block that has one bound, blocks looked at together.
BLOCK, WINDOW = 128, 64
#: A list is short if it has at most one of so many of its segment's documents.
SHORT = 16
#: Terms of all items that go to the segments at once, about; more items are searched in further passes over the index.
PASS_TERMS = 200_000
#: Groups between a task's best documents of an item and the item's.
MIDDLE = 64

TERMS = Terms(digits=True)
_INDEX = "segment long, term binary, held int, places binary, counts binary, doc_ids array<long>"


def _written(segment: int, ids: list, lengths: list[int], postings: dict) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("held", pa.int32()), ("places", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([segment], [None], [len(ids)], [b""], [np.array(lengths, "<i8").tobytes()], [ids]), schema.types, strict=True)], schema=schema)
    order = sorted(postings)
    for k in range(0, len(order), WRITTEN):
        some = order[k : k + WRITTEN]
        lists = [postings[t] for t in some]
        columns = [segment] * len(some), some, [len(p) for p, _ in lists], [p.tobytes() for p, _ in lists], [c.tobytes() for _, c in lists], [None] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment, ids, lengths, postings, held = TaskContext.get().partitionId() << 32, [], [], {}, 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = TERMS.counted(text.as_py())
            if not counts:
                continue
            place = len(ids)
            for term, n in counts.items():
                if (lists := postings.get(term)) is None:
                    lists = postings[term] = (array("H"), array("I"))
                lists[0].append(place)
                lists[1].append(n)
            ids.append(doc_id)
            lengths.append(counts.total())
            held += len(counts)
            if held >= POSTINGS or len(ids) == DOCUMENTS:
                yield from _written(segment, ids, lengths, postings)
                segment, ids, lengths, postings, held = segment + 1, [], [], {}, 0
    if ids:
        yield from _written(segment, ids, lengths, postings)
    base.give_back()


def index(docs: DataFrame) -> DataFrame:
    """The settled index of docs (doc_id, text): a row for each term of a segment, and one, with a null term, for its documents
    and their lengths. Texts without a term are left out. Rows of a repeated or null doc_id are documents of their own; columns other
    than the two do not matter. No documents give an empty index."""
    base.short_batches(docs.sparkSession)
    return base.settle(base.only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary")).mapInArrow(_segments, _INDEX), "segments")


def _asked(items: DataFrame) -> DataFrame:
    """item_id, term, times. Rows of one item_id, null too, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if counts := TERMS.counted(text.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _floors(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """25 + (75 * n * N) div L, exact also where the product leaves 64 bits."""
    wide = 75 * int(n.max()) * documents >= 1 << 63
    return 25 + ((75 * n.astype(object) * documents // total).astype(np.int64) if wide else 75 * n * documents // total)


class _Best:
    """An item's best documents so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """What a document must reach to matter: equal scores may still win by their id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


class _List:
    """A term's postings in a segment: places, what each adds for a weight of one, and the most that a block's add."""

    def __init__(self, places: bytes, counts: bytes, m: np.ndarray, blocks: int):
        self.places, tf = np.frombuffer(places, "<u2").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64)
        self.adds = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.places])
        block = self.places // BLOCK
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        self.peaks = np.zeros(blocks, np.int64)
        self.peaks[block[starts]] = np.maximum.reduceat(self.adds, starts)


def _search(wanted: list[tuple[int, _List]], ids: np.ndarray, blocks: int, best: _Best) -> int:
    """Adds a segment's documents to an item's best ones; wanted: weights and lists. Gives the number of documents looked at."""
    n, looked = len(ids), 0
    short = [x for x in wanted if SHORT * len(x[1].places) <= n]
    long = sorted((x for x in wanted if SHORT * len(x[1].places) > n), key=lambda x: -x[0] * int(x[1].peaks.max()))
    sums = np.zeros(blocks * BLOCK, np.int64)
    for weight, held in short:
        sums[held.places] += weight * held.adds
    rest = sum((weight * held.peaks for weight, held in long), np.zeros(blocks, np.int64))
    bounds = sums.reshape(blocks, BLOCK).max(axis=1) + rest
    # Ten documents with sums of their own score at least the tenth of these.
    known = int(np.partition(sums, -best.k)[-best.k]) if len(sums) >= best.k else 0
    for start in range(0, blocks, WINDOW):
        floor = max(best.floor, known)
        live = start + np.flatnonzero(bounds[start : start + WINDOW] >= floor)
        docs = (live[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        docs = docs[docs < n]
        looked += len(docs)
        score, left = sums[docs], rest[docs // BLOCK]
        for weight, held in long:
            may = score + left >= floor
            docs, score, left = docs[may], score[may], left[may]
            if not len(docs):
                break
            at = np.minimum(np.searchsorted(held.places, docs), len(held.places) - 1)
            score = score + np.where(held.places[at] == docs, weight * held.adds[at], 0)
            left = left - weight * held.peaks[docs // BLOCK]
        may = score >= floor
        if may.any():
            best.add(score[may], ids[docs[may]])
    return looked


def _searcher(k: int, documents: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, _Best] = {}
        segment = ids = m = asked = None
        lists: dict[bytes, _List] = {}

        def finish() -> None:
            blocks = -(-len(ids) // BLOCK)
            for item, terms in asked.items():
                wanted = [(w, lists[t]) for t, w in terms if t in lists and w]
                if wanted:
                    _search(wanted, ids, blocks, best.setdefault(item, _Best(k)))
            lists.clear()

        for batch in batches:
            segments, terms, places, counts, doc_ids, queries = (batch.column(c) for c in ("segment", "term", "places", "counts", "doc_ids", "queries"))
            for r in range(batch.num_rows):
                if not terms[r].is_valid:  # a segment begins with its documents
                    if segment is not None:
                        finish()
                    segment = segments[r].as_py()
                    ids = np.array([NO_ID if x is None else x for x in doc_ids[r].as_py()], np.int64)
                    m, asked = _floors(np.frombuffer(counts[r].as_py(), "<i8"), documents, total), {}
                    for q in queries[r].as_py():
                        asked.setdefault(q["item_id"], []).append((q["term"], q["weight"]))
                else:
                    lists[terms[r].as_py()] = _List(places[r].as_py(), counts[r].as_py(), m, -(-len(ids) // BLOCK))
        if segment is not None:
            finish()
        for item, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.ids), pa.int64()), pa.array([None if x == NO_ID else int(x) for x in b.ids], pa.int64()), pa.array(b.scores, pa.int64())], names=["item_id", "doc_id", "score"])
        base.give_back()

    return run


#: Stands for a null doc_id in arrays; it sorts last, as null does in the result.
NO_ID = np.iinfo(np.int64).max


def search(segments: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents with a score above 0 for each item (item_id, text).

    Equal scores go by ascending doc_id, null last. Rows with one item_id are one item. An item without terms, or whose terms no
    document holds, has no rows; an empty index or no items give none.
    """
    spark = segments.sparkSession
    postings, heads = segments.where("term is not null"), segments.where("term is null")
    # A segment's lengths are packed: unpacked, they are 8 bytes each, low ones first.
    sizes = heads.select("held", "counts").mapInArrow(_lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, total = sizes[0] or 0, sizes[1] or 0
    asked = base.settle(_asked(items), "asked")
    df = postings.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighed = base.settle(asked.join(df, "term").select("item_id", "term", (weight * F.col("times")).cast("long").alias("weight")), "weighed")
    passes = -(-weighed.count() // PASS_TERMS)
    out = None
    for k_pass in range(passes):
        some = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k_pass) if passes > 1 else weighed
        # About PASS_TERMS terms in one row, whatever the number of items: it is the block of queries that all segments see.
        packed = some.agg(F.collect_list(F.struct("item_id", "term", "weight")).alias("queries"))
        first = heads.crossJoin(F.broadcast(packed))
        lists = postings.join(some.select("term").distinct(), "term").withColumn("queries", F.lit(None).cast(packed.schema["queries"].dataType))
        columns = ["segment", "term", "places", "counts", "doc_ids", "queries"]
        rows = first.select(columns).unionByName(lists.select(columns)).repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())
        best = rows.mapInArrow(_searcher(k, documents, total), "item_id long, doc_id long, score long")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = F.desc("score"), F.col("doc_id").asc_nulls_last()
    some = out.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(MIDDLE)))
    some = some.withColumn("_n", F.row_number().over(W.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("_n") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = sum(int(np.frombuffer(x.as_py(), "<i8").sum()) for x in batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([sum(batch.column(0).to_pylist())], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])

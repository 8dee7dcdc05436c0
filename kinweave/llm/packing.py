"""Best-fit packing of token sequences with swap-based local search.

Documents are dealt into groups of bounded size by a hash. A group is packed by best fit
decreasing; then bins that are not full exchange one piece for one, two for one, or take a
piece over, whenever that raises the sum of squared fills, until bins run empty or the
lower bound of the group is reached. Each group may leave one bin partly filled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .tokens import encoder

#: Tokens in a sequence.
CAPACITY = 2048
#: Pieces packed together in one task, on average.
GROUP_PIECES = 20_000


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest piece first, each into the fullest bin that still takes it."""
    bins, spare = [], []  # spare: (room, bin), ascending
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = bisect_left(spare, (n, -1))
        if at < len(spare):
            room, b = spare.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        if room > n:
            insort(spare, (room - n, b))
    return bins


def _given_back(held: list[int]) -> dict[int, tuple[int, ...]]:
    """What a bin can give back for a piece: nothing, one piece or two, by their length. held: lengths in it."""
    sizes, out = sorted(set(held)), {0: ()}
    for k, x in enumerate(sizes):
        for y in sizes[k:]:
            if x != y or held.count(x) > 1:
                out.setdefault(x + y, (x, y))
    return out | {x: (x,) for x in sizes}


class Search:
    """Bins that are not full, found by what they can give back: for each length of that, (room, bin) in order."""

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.room = [capacity - sum(size[k] for k in b) for b in bins]
        self.backs: dict[int, dict[int, tuple[int, ...]]] = {}
        self.takers: dict[int, list[tuple[int, int]]] = {}
        for b in range(len(bins)):
            self._put(b)

    def _put(self, b: int) -> None:
        if self.bins[b] and self.room[b]:
            self.backs[b] = _given_back([self.size[k] for k in self.bins[b]])
            for v in self.backs[b]:
                insort(self.takers.setdefault(v, []), (self.room[b], b))

    def _take(self, b: int) -> None:
        for v in self.backs.pop(b, ()):
            held = self.takers[v]
            held.pop(bisect_left(held, (self.room[b], b)))
            if not held:
                del self.takers[v]

    def give(self, giver: int) -> bool:
        """The exchange of one of the giver's pieces that leaves the taker fullest, if any raises the sum of squared fills."""
        room = self.room[giver]
        for piece in sorted(self.bins[giver], key=lambda k: (-self.size[k], k)):
            best, s = None, self.size[piece]
            for v, held in self.takers.items():
                if v < s:
                    at = bisect_left(held, (s - v, -1))
                    if at < len(held) and held[at][1] == giver:
                        at += 1
                    # The sum rises if the taker ends fuller than the giver was.
                    if at < len(held) and held[at][0] - (s - v) < room:
                        found = (held[at][0] - (s - v), v, held[at][1])
                        best = found if best is None or found < best else best
            if best:
                _, v, taker = best
                back = []
                for x in self.backs[taker][v]:
                    back.append(next(k for k in self.bins[taker] if self.size[k] == x and k not in back))
                self._take(giver)
                self._take(taker)
                self.bins[giver] = [k for k in self.bins[giver] if k != piece] + back
                self.bins[taker] = [k for k in self.bins[taker] if k not in back] + [piece]
                self.room[giver] += s - v
                self.room[taker] -= s - v
                self._put(giver)
                self._put(taker)
                return True
        return False


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search: from the emptiest open bin on, move a piece into another, or exchange it for one or two shorter pieces there,
    where that raises the sum of squared fills; until no exchange does, or the fewest possible bins are left."""
    least = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    live = sum(map(bool, bins))
    if live <= least:
        return bins
    search, moved = Search(bins, lengths.tolist(), capacity), True
    while moved and live > least:
        moved = False
        for giver in sorted((b for b in range(len(bins)) if bins[b] and search.room[b]), key=lambda b: (-search.room[b], b)):
            while live > least and bins[giver] and search.give(giver):
                moved = True
                live -= not bins[giver]
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Lengths are 1 to capacity; bins are numbered from 0."""
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, held in enumerate(bins):
        at = 0
        for k in sorted(held):
            where[k], offset[k] = b, at
            at += int(lengths[k])
    return where, offset


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document: its whole text's ids and end_id,
    cut after every ``capacity`` ids. A null text counts as empty and gives a piece of end_id alone."""
    base.short_batches(docs.sparkSession)

    def cut(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.ids(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(doc, at // capacity, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].tobytes())) for at in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return base.only(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, piece long, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Each piece with sequence_id and offset. Rows with equal or null ids are packed like others; an empty table gives no rows."""
    cut = base.settle(pieces(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, round(cut.count() / group_pieces))

    def packed(key, rows):
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        where, rows["offset"] = pack_lengths(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = where + (int(key[0]) << 32)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"piece": "int32"})

    # Dealt by row, not by content: repeated rows don't crowd one group.
    dealt = cut.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    return dealt.groupBy("deal").applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

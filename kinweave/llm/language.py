"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes, learned once and then
frozen. A byte costs -log2 of its share in its longest known context; where it was never
seen there, the context's escape is paid and the next shorter context asked, down to 8
bits for any byte (escape method C, no exclusions). Because statistics are frozen, the
cost of a byte depends on four bytes alone, so the costs of all known four-byte strings
are tabulated for all languages side by side and texts are scored by look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Longest context in bytes; four-byte strings fit a 32-bit key.
ORDER = 3
#: Training documents of a language, about: a bounded sample of its labelled documents, by a hash of the id.
TRAIN_DOCS = 1500
#: Bytes scored at a time.
SLICE_BYTES = 1_000_000
#: Bits a byte above which no learned language explains a text (the filter's rule).
MAX_BITS = 7.0

_letter = re.compile(r"[^\W\d_]")


def _keys(texts: Sequence[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``length`` bytes that end at each byte of each text, zero bytes in front; and each text's first place."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(b"\0" * ORDER + t for t in texts), np.uint8).astype(np.uint32)
    real = np.ones(len(data), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    for k in range(ORDER):
        real[starts + k] = False
    key = np.zeros(len(data), np.uint32)
    for back in range(length):
        key[back:] |= data[: len(data) - back] << np.uint32(8 * back)
    return key[real], np.cumsum(sizes) - sizes


@dataclass
class Trees:
    languages: list[str]
    known: list[np.ndarray]  # by order: sorted strings of order + 1 bytes
    cost: list[np.ndarray]  # their bits in each language
    contexts: list[np.ndarray]  # by order: sorted contexts
    escape: list[np.ndarray]  # bits of leaving them in each language

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)

    def bits_of(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each key in each language."""
        if order < 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        at, seen = self._find(self.known[order], keys)
        out = self.cost[order][at]
        if not seen.all():
            rest = keys[~seen]
            shorter = rest & np.uint32((1 << (8 * order)) - 1)
            at, there = self._find(self.contexts[order], rest >> np.uint32(8))
            out[~seen] = self.bits_of(shorter, order - 1) + self.escape[order][at] * there[:, None]
        return out

    def bits(self, texts: Sequence[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        for k, t in enumerate(texts):  # long texts in slices, each with the bytes before it
            for at in range(SLICE_BYTES, len(t), SLICE_BYTES):
                keys, _ = _keys([t[at - ORDER : at + SLICE_BYTES]], ORDER + 1)
                total[k] += self.bits_of(keys[ORDER:]).sum(axis=0, dtype=np.float64)
        first, size = 0, 0
        for k in range(len(texts) + 1):
            n = min(len(texts[k]), SLICE_BYTES) if k < len(texts) else 0
            if k == len(texts) or size + n > SLICE_BYTES and k > first:
                part = [t[:SLICE_BYTES] for t in texts[first:k]]
                if any(part):
                    keys, starts = _keys(part, ORDER + 1)
                    sums = np.vstack([np.zeros(len(self.languages)), np.cumsum(self.bits_of(keys), axis=0, dtype=np.float64)])
                    total[first:k] += sums[np.append(starts[1:], len(keys))] - sums[starts]
                first, size = k, 0
            size += n
        return total


def build(languages: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray) -> Trees:
    """Trees from the counts of four-byte strings; shorter strings' counts are their sums."""
    known, cost, contexts, escape = [], [], [], []
    trees = Trees(languages, known, cost, contexts, escape)
    for order in range(ORDER + 1):
        cut = key & np.uint32((1 << (8 * order + 8)) - 1)
        strings = np.unique(cut)
        table = np.zeros((len(strings), len(languages)))
        np.add.at(table, (np.searchsorted(strings, cut), lang), count)
        parents, of = np.unique(strings >> np.uint32(8), return_inverse=True)
        total, distinct = np.zeros((2, len(parents), len(languages)))
        np.add.at(total, of, table)
        np.add.at(distinct, of, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
            direct = -np.log2(table / (total + distinct)[of])
        lower = trees.bits_of(strings & np.uint32((1 << (8 * order)) - 1), order - 1)
        known.append(strings.astype(np.uint32))
        contexts.append(parents.astype(np.uint32))
        escape.append(leave)
        cost.append(np.where(table > 0, direct, leave[of] + lower))
    return trees


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Trees:
    """Learns from documents with a language whose fold of four is not 2: a sample of train_docs of each language, about,
    all of whose strings count. What comes to the driver is bounded by that and by the number of languages. No such
    document: no language, and every prediction is ``und``."""
    spark = docs.sparkSession
    base.short_batches(spark)
    labelled = base.only(docs, "doc_id", "text", "lang").where((base.fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(have)
    if not languages:
        return Trees([], [], [], [], [])
    share = F.element_at(F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, train_docs / have[lang])))), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("ppm")), F.lit(1 << 30)) < share * (1 << 30))
    number = {lang: k for k, lang in enumerate(languages)}

    def counted(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array([number[x] for x in batch.column("lang").to_pylist()])
            for k in np.unique(langs):
                keys, _ = _keys([t.encode() for t, x in zip(texts, langs, strict=True) if x == k], ORDER + 1)
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int64)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    strings = sample.select("text", "lang").mapInArrow(counted, "lang long, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    got = strings.toArrow()  # no more than TRAIN_DOCS documents of each language have
    return build(languages, got["lang"].to_numpy().astype(np.int64), got["key"].to_numpy().astype(np.uint32), got["n"].to_numpy())


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every whole text.

    The language with the shortest code wins, at a tie the first by name; score is its share when code lengths are
    taken as probabilities. Null texts and texts without a letter are ``und`` with score 0 and null bits.
    """
    spark = docs.sparkSession
    base.short_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    def predicted(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ok = [k for k, t in enumerate(texts) if t and _letter.search(t) and model.languages]
            names, score, per = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            if ok:
                raw = [texts[k].encode() for k in ok]
                bits = model.bits(raw)
                best = bits.argmin(axis=1)
                chance = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                for j, k in enumerate(ok):
                    names[k], score[k], per[k] = model.languages[best[j]], chance[j], float(bits[j, best[j]] / len(raw[j]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(score), pa.array(per, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = base.only(docs, "doc_id", "text").select("doc_id", "text", (base.fold("doc_id", 4) == 2).alias("held_out"))
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that some learned language explains: texts without a letter go, and texts
    that take more than MAX_BITS bits a byte in every language."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    base.short_batches(docs.sparkSession)

    def kept(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lettered = np.array([bool(t and _letter.search(t)) for t in texts], bool)
            raw = [t.encode() if on else b"" for t, on in zip(texts, lettered, strict=True)]
            if model.languages:
                lettered &= model.bits(raw).min(axis=1, initial=np.inf) <= MAX_BITS * np.array([max(1, len(t)) for t in raw])
            yield batch.filter(pa.array(lettered))

    return docs.mapInArrow(kept, docs.schema)

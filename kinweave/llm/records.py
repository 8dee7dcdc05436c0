"""Length-delimited binary records of token ids, with masked checksums and an offset index.

A record is: length (8 bytes, little endian), masked CRC-32C of those, the payload, its
masked CRC-32C (4 bytes), and one line feed that Spark's text sink adds. The payload is
doc_id (8 bytes), a flag byte (1: doc_id is null), the id width in bytes, and the ids,
little endian. Files are written by Spark's own sink, so they go to any file system,
commits are atomic and a lost executor costs only a retried task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import base
from .tokens import encoder

#: Bytes of text in one file, on average.
FILE_BYTES = 24_000_000
_BLOCK = 1024


def _shift_table(power: int) -> list[np.ndarray]:
    """What appending ``power`` zero bytes does to each byte of a CRC register."""
    state = np.zeros((4, 256), np.uint32)
    for k in range(4):
        state[k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for _ in range(power):
        state = (state >> np.uint32(8)) ^ _byte_table[state & np.uint32(255)]
    return list(state)


def _bytes_of_polynomial() -> np.ndarray:
    #: Fixed value: the reversed Castagnoli polynomial.
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0x82F63B78), table >> np.uint32(1)).astype(np.uint32)
    return table


_byte_table = _bytes_of_polynomial()
_by_word, _by_block = _shift_table(4), _shift_table(_BLOCK)


def _moved(state: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][(state >> 8) & 255] ^ tables[2][(state >> 16) & 255] ^ tables[3][state >> 24]


def masked_crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part (4 bytes or more), rotated by 15 bits plus a fixed value.

    Parts are padded in front with zeros, which leave a zero register alone, to whole
    blocks; the start value is xored into the first four bytes. All blocks of all parts
    advance together, four bytes a step, then blocks of a part are chained.
    """
    if not parts:
        return np.zeros(0, np.uint32)
    blocks = np.array([-(-len(p) // _BLOCK) for p in parts])
    flat = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
    begins = (np.cumsum(blocks) - blocks) * _BLOCK
    for p, n, at in zip(parts, blocks, begins, strict=True):
        first = at + n * _BLOCK - len(p)
        flat[first : first + len(p)] = np.frombuffer(p, np.uint8)
        flat[first : first + 4] ^= np.uint8(255)
    words = np.ascontiguousarray(flat.view("<u4").reshape(-1, _BLOCK // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for row in words:
        state = _moved(state ^ row, _by_word)
    out = np.zeros(len(parts), np.uint32)
    first = begins // _BLOCK
    for k in range(int(blocks.max())):
        on = np.nonzero(blocks > k)[0]
        out[on] = _moved(out[on], _by_block) ^ state[first[on] + k]
    out = ~out
    #: Fixed value: the mask's addend.
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(doc_ids: list[int | None], ids: list[np.ndarray], wide: bool) -> list[bytes]:
    kind = np.dtype("<u4" if wide else "<u2")
    payloads = [(d or 0).to_bytes(8, "little", signed=True) + bytes([d is None, kind.itemsize]) + x.astype(kind).tobytes() for d, x in zip(doc_ids, ids, strict=True)]
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    return [n + int(a).to_bytes(4, "little") + p + int(b).to_bytes(4, "little") for n, a, p, b in zip(lengths, masked_crc32c(lengths), payloads, masked_crc32c(payloads), strict=True)]


def parse(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record of a file; raises ValueError where a checksum is wrong."""
    found, at, view = [], 0, memoryview(content)
    while at < len(content):
        n = int.from_bytes(view[at : at + 8], "little")
        if at + 17 + n > len(content):
            raise ValueError(f"a record at {at} is cut short")
        found.append((at, bytes(view[at + 12 : at + 12 + n])))
        at += 17 + n
    for k in range(0, len(found), 256):
        group = found[k : k + 256]
        said = [(int.from_bytes(view[a + 8 : a + 12], "little"), int.from_bytes(view[a + 12 + len(p) : a + 16 + len(p)], "little")) for a, p in group]
        real = zip(masked_crc32c([len(p).to_bytes(8, "little") for _, p in group]), masked_crc32c([p for _, p in group]), strict=True)
        if any((int(x), int(y)) != s for (x, y), s in zip(real, said, strict=True)):
            raise ValueError("a record's checksum is wrong")
        yield from group


def decode(payload: bytes) -> tuple[int | None, np.ndarray]:
    width = payload[9]
    return (None if payload[8] else int.from_bytes(payload[:8], "little", signed=True)), np.frombuffer(payload, f"<u{width}", offset=10)


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Encodes each whole text, adds end_id, and writes records in ascending doc_id order (null ids first,
    equal ids by a digest of the text, so that many rows of one id are spread over files) to path/records, and path/index: file, offset, length, doc_id, n_tokens and place.
    A null text counts as empty: its record has end_id alone. An empty table writes no record."""
    spark = docs.sparkSession
    base.short_batches(spark)
    docs = base.only(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The range boundaries come from ids and digests alone: texts are encoded after the exchange, once.
    order = F.col("doc_id").asc_nulls_first(), F.col("tie")
    docs = docs.withColumn("tie", F.xxhash64("text"))
    ranged = docs.repartitionByRange(max(1, -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order, "text")

    def framed(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in coder.ids(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(frames(batch.column("doc_id").to_pylist(), ids, max(coder.size, end_id + 1) > 65536), pa.binary())], ["value"])

    ranged.mapInArrow(framed, "value binary").select(F.col("value").cast("string")).write.text(f"{path}/records", lineSep="\n")
    _scan(spark, path).drop("ids_crc32").write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/records").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: file, place in the file, offset, length, doc_id, n_tokens, ids before it in its file, checksum of its ids."""

    def scanned(batches):
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows, before = [], 0
                for k, (at, payload) in enumerate(parse(content.as_py())):
                    doc, ids = decode(payload)
                    rows.append((name, k, at, len(payload) + 17, doc, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["file", "record", "offset", "length", "doc_id", "n_tokens", "before", "ids_crc32"]
    kinds = [pa.string(), *[pa.int64()] * 7]
    return _files(spark, path).mapInArrow(scanned, "file string, record long, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Reads every file back, checks every record, and returns doc_id, start (ids of all records before it),
    n_tokens, ids_crc32, file and offset."""
    totals = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # One row a file: their numbers ascend with the doc_ids. As text, names of more than five digits would not.
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    bases = totals.select("file", (F.sum("total").over(W.orderBy(number)) - F.col("total")).alias("base"))
    return _scan(spark, path).join(bases, "file").selectExpr("doc_id", "base + before as start", "n_tokens", "ids_crc32", "file", "offset")


def shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, ids of all records in a random order that depends on seed alone. The index gives each file's entries; each is
    cut out of its file by offset and length, and its checksums are compared."""
    entries = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("entries"))  # a file is bounded

    def cut(batches):
        for batch in batches:
            for file, content, held in zip(batch.column("file").to_pylist(), batch.column("content"), batch.column("entries").to_pylist(), strict=True):
                content, rows = content.as_py(), []
                for e in held:
                    ((_, payload),) = parse(content[e["offset"] : e["offset"] + e["length"]])
                    doc, ids = decode(payload)
                    ticket = int.from_bytes(hashlib.blake2b(f"{seed} {file} {e['offset']}".encode(), digest_size=8).digest(), "little", signed=True)
                    rows.append((doc, len(ids), ids.astype(np.int64), ticket))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_tokens", "ids", "ticket"])

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    found = _files(spark, path).join(entries, "file").mapInArrow(cut, "doc_id long, n_tokens long, ids array<long>, ticket long")
    return found.orderBy("ticket", "doc_id").drop("ticket")

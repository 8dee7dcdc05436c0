"""Near-duplicates by SetSketch registers over word shingles.

A document's shingle set gives 640 registers: exponentially distributed minima on a logarithmic scale, truncated to a byte.
Registers of a union are the maxima, so sketches merge; registers agree the likelier the more shingles are shared, so
bands of them find candidates. Documents with the same set form a class. Classes that share a band bucket, directly or
over others, form a cluster; a cluster is dealt into blocks of bounded size, and two blocks meet in a task if any bucket
has members of both. There a joint likelihood over both sketches and set sizes drops far pairs and full sets decide the
rest; pairs that others connect already are passed over, and only the links that connect are returned. So no pair that shares a bucket
is left undecided, and rows grow with the members of a group, not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .tokens import slices

#: Bands and registers in a band: a pair of similarity 0.8 shares no band with a chance of about 1 in 1500, one of 0.85 in a million.
BANDS, ROWS = 64, 10
REGISTERS = BANDS * ROWS
#: Base of the registers' scale, and the time at which it begins.
SCALE, LAST = 1.1, 20.0
#: Standard errors that an estimate may lie below the threshold before a pair is dropped.
ERRORS = 4.5
#: Bytes of sets and sketches in a block, about.
BLOCK_BYTES = 4_000_000

_random = np.random.default_rng(20240229)
_factor = _random.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_shift = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``size`` words; with fewer words the whole sequence is one."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    codes = coded.indices.to_numpy()
    real = np.array([w != "" for w in words], bool)[codes] if len(words) else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy()]
    w = hashes[codes[real]] if len(words) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _PRIME + w[k : k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for x in w[a:b]:
                short = np.uint64((int(short) * int(_PRIME) + int(x)) & (2**64 - 1))
            out.append(_mix(np.array([short ^ np.uint64(0x5DEECE66D)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches of the sets, one row each; a row of zeros for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = (np.concatenate([sets[k] for k in full]) >> np.uint64(16)).astype(np.uint32)
        sizes = np.array([len(sets[k]) for k in full])
        starts = np.cumsum(sizes) - sizes
        hashed, least = np.empty_like(flat), np.empty((REGISTERS, len(full)), np.uint32)
        for j in range(REGISTERS):
            np.multiply(flat, _factor[j], out=hashed)
            hashed += _shift[j]
            least[j] = np.minimum.reduceat(hashed, starts)
        times = -np.log1p(-(least.T + 0.5) / 2.0**32)  # exponential with the set's size as rate
        out[full] = np.clip(np.floor(1 + (np.log(LAST) - np.log(times)) / np.log(SCALE)), 0, 255)
    return out


def _above(x: np.ndarray) -> np.ndarray:
    """Chance of a higher register, given the share of a union's elements that only this side has."""
    return -np.log1p(-x * (SCALE - 1) / SCALE) / np.log(SCALE)


_GRID = np.linspace(0.4, 1, 121)


def estimate(equal: np.ndarray, above: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity from 0.4 to 1 under which what is seen of two sketches (registers equal, above) is likeliest, given the set sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    higher, lower = (np.maximum(_above(np.maximum(x - (1 - x) * _GRID, 0)), 1e-9) for x in (u, 1 - u))
    same = np.maximum(1 - higher - lower, 1e-9)
    below = REGISTERS - equal - above
    return _GRID[sum(n[:, None] * np.log(p) for n, p in ((equal, same), (above, higher), (below, lower))).argmax(axis=1)]


def slack(threshold: float) -> float:
    return ERRORS * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def sketch(docs: DataFrame, size: int, whole: bool = False) -> DataFrame:
    """doc_id, key (which stands for a row's id: a null one is a hash of the text), n_shingles, class (16 bytes that name the
    set; null: empty) and as data the registers, or with ``whole`` the set itself."""
    base.short_batches(docs.sparkSession)

    def sketched(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sets = [s for a, b in slices(texts, 1_000_000) for s in shingle_sets(texts[a:b], size)]
            if whole:
                data = [s.tobytes() for s in sets]
            else:
                data = [r.tobytes() for a in range(0, len(sets), 100) for r in registers(sets[a : a + 100])]
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(data, pa.binary())], ["doc_id", "key", "n_shingles", "class", "data"])

    return with_key(docs).mapInArrow(sketched, "doc_id long, key long, n_shingles long, class binary, data binary")


def with_key(docs: DataFrame) -> DataFrame:
    return base.only(docs, "doc_id", "text").withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))


def banded(classes: DataFrame) -> DataFrame:
    """(band, id) of each class: a hash of each band's registers and number."""

    def run(batches):
        for batch in batches:
            r = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.uint64)
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2])
            for j in range(ROWS):
                band = _mix(band * _PRIME + r[:, :, j])
            yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], ["band", "id"])

    return classes.select("id", "data").mapInArrow(run, "band long, id long")


def linked(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], data: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of a cluster that connect all that are linked: pairs of places. side: -1 and 1 if only pairs
    of unlike sides count, 0 if all do."""
    n, part, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    threshold = percent / 100
    least = REGISTERS * threshold - ERRORS * (REGISTERS * threshold * (1 - threshold)) ** 0.5
    for i in range(len(sets) - 1):
        other = np.flatnonzero((part[i + 1 :] != part[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :])) & ((side[i] == 0) | (side[i + 1 :] != side[i]))) + i + 1
        for k in range(0, len(other), 4096):
            j = other[k : k + 4096]
            equal = (data[j] == data[i]).sum(axis=1)
            j, equal = j[equal >= least], equal[equal >= least]
            if len(j):
                like = estimate(equal, (data[j] < data[i]).sum(axis=1), np.full(len(j), n[i]), n[j])
                for m in j[like >= threshold - slack(threshold)].tolist():
                    if part[m] != part[i]:
                        shared = len(np.intersect1d(sets[i], sets[m], assume_unique=True))
                        if 100 * shared >= percent * (n[i] + n[m] - shared):
                            out.append((int(ids[i]), int(ids[m])))
                            part[part == part[m]] = part[i]
    return out


def blocks_of(clusters: DataFrame, buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, cluster, task, left, right): the pairs of blocks in which each class takes part. Clusters below a block's size share tasks."""
    sized = clusters.join(sizes, "id").selectExpr("id", "cluster", "bytes")
    total = sized.groupBy("cluster").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks"), F.sum("bytes").alias("all"))
    tasks = 1 + (total.where("blocks = 1").agg(F.sum("all")).first()[0] or 0) // BLOCK_BYTES
    placed = base.settle(sized.join(total, "cluster").select("id", "cluster", "blocks", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block")), "placed")
    small = placed.where("blocks = 1").select("id", "cluster", (-1 - F.pmod(F.xxhash64("cluster"), F.lit(tasks))).alias("task"), "block", F.col("block").alias("left"), F.col("block").alias("right"))
    large = buckets.select("band", "id").join(placed.where("blocks > 1"), "id")
    met = large.join(large.select("band", F.col("block").alias("other")).distinct(), "band")
    pairs = met.select("id", "cluster", F.col("cluster").alias("task"), "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).distinct()
    return small.unionByName(pairs)


def links(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): ids of classes whose sets are alike, as many as connect all that share a bucket."""
    bands = banded(classes)
    hubs = bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("band", "hub")
    buckets = base.settle(bands.join(hubs, "band"), "buckets")
    clusters = base.components(buckets.where("id <> hub").selectExpr("hub a", "id b").distinct()).selectExpr("node id", "component cluster")
    blocks = blocks_of(clusters, buckets, classes.selectExpr("id", f"n_shingles * 8 + {REGISTERS} bytes"))
    met = blocks.join(classes.select("id", "class", "key", "data"), "id")
    wanted = met.select("key").distinct()
    whole = sketch(with_key(docs).join(wanted, "key", "left_semi"), size, whole=True).where("class is not null")
    sets = whole.groupBy("class").agg(F.first("data").alias("set"))

    def decided(group):
        group = group.sort_by([("cluster", "ascending"), ("id", "ascending")])
        ids, cluster, block = (group.column(c).to_numpy() for c in ("id", "cluster", "block"))
        left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
        side = np.zeros(len(ids), np.int8) if left == right else np.where(block == left, -1, 1)
        data, sets = group.column("data").to_pylist(), group.column("set").to_pylist()
        ends = np.flatnonzero(np.append(cluster[1:] != cluster[:-1], True)) + 1
        out = []
        for a, b in zip(np.append(0, ends), ends, strict=False):
            rows = np.frombuffer(b"".join(data[a:b]), np.uint8).reshape(-1, REGISTERS)
            out += linked(ids[a:b], side[a:b], [np.frombuffer(s, np.uint64) for s in sets[a:b]], rows, percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    full = met.drop("key").join(sets, "class").select("task", "left", "right", "cluster", "block", "id", "data", "set")
    return base.settle(full.groupBy("task", "left", "right").applyInArrow(decided, "a long, b long"), "links")


def classes_of(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Null and wordless texts have no shingles and are linked with nothing. Rows of one doc_id belong together even if their
    texts differ. A row whose doc_id is null takes part under its text; component_id is null where no member has an id,
    and kept is then null. An empty table gives no rows; other columns are not read.
    """
    rows = base.settle(sketch(docs, size), "sketches")
    grouped = rows.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("data").alias("data"), F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    classes = base.settle(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    alike = links(classes, docs, size, percent)
    # Rows of one id with several texts: all are tied to one of them.
    several = rows.where("doc_id is not null and class is not null").groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("doc_id", "low")
    ties = rows.join(several, "doc_id").where("class <> low").select("class", "low").distinct()
    number = classes.select("class", "id")
    ties = ties.join(number.withColumnRenamed("id", "a"), "class").join(number.selectExpr("class low", "id b"), "low").select("a", "b")
    whole = base.components(alike.unionByName(ties))
    named = classes.select("class", "id", "doc_id").join(whole.selectExpr("node id", "component"), "id", "left").selectExpr("class", "doc_id", "coalesce(component, id) part")
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "part").select("class", "component_id")
    out = rows.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without those linked to one of a smaller id. Rows without id stay; of rows with
    the same id all stay if the id does."""
    gone = classes_of(docs, size, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)

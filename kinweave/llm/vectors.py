"""Embedding near-duplicates by a forest of random projection trees.

A tree splits by random directions at the median; points near it spill to both sides, so
the halves of a dense group stay tied together. The upper part of each tree is fitted on a
bounded sample and sends every vector to its leaves; each leaf, in one task, is split
further on its own rows down to small leaves, in which all vectors are compared. What is
linked there is united; then each group, in blocks, counts every link among its members
exactly. Equal vectors form a class and are compared once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

#: Trees, share of a node's points that spill to both sides, vectors in the smallest leaves.
TREES, SPILL, LEAF = 10, 0.15, 256
#: Vectors that the upper trees are fitted on, about (by a hash of the id), and how many of those a leaf has at least.
SAMPLE, SAMPLE_LEAF = 20_000, 16
#: Vectors that an upper leaf should get.
UPPER_LEAF = 2000
#: Vectors in an upper leaf from which it is split further by its own quantiles.
MOST = 16_000
#: Members of a group compared in one block, at most; smaller groups of over 64 are dealt into up to 8 blocks.
BLOCK = 2048


def split(x: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, float, float]:
    """A direction and the ends of its overlap: up to the upper one is left, from the lower one on is right."""
    way = random.standard_normal(x.shape[1])
    low, high = np.quantile(x @ way, [0.5 - SPILL / 2, 0.5 + SPILL / 2])
    return way, float(low), float(high)


def grow(x: np.ndarray, depth: int, random: np.random.Generator) -> tuple | None:
    """(direction, low, high, left, right), or None for a leaf."""
    if depth == 0 or len(x) < 2 * SAMPLE_LEAF:
        return None
    way, low, high = split(x, random)
    p = x @ way
    return way, low, high, grow(x[p <= high], depth - 1, random), grow(x[p >= low], depth - 1, random)


def route(node: tuple | None, x: np.ndarray, rows: np.ndarray, number: int = 1):
    """(leaf number, rows) of every leaf that gets rows."""
    if not len(rows):
        return
    if node is None:
        yield number, rows
        return
    p = x[rows] @ node[0]
    yield from route(node[3], x, rows[p <= node[2]], 2 * number)
    yield from route(node[4], x, rows[p >= node[1]], 2 * number + 1)


def leaves(x: np.ndarray, random: np.random.Generator):
    """Rows of each small leaf of a set of vectors. Where overlaps don't shrink a set, as among equal projections, halves are
    cut by rank."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            yield rows
            continue
        way = random.standard_normal(x.shape[1])
        order = rows[np.argsort(x[rows] @ way, kind="stable")]
        spill, half = int(len(order) * SPILL / 2), len(order) // 2
        todo += [order[: half + spill], order[half - spill :]]


def unite(links: np.ndarray) -> np.ndarray:
    """For a boolean link matrix: the first member of each member's connected part."""
    part = np.full(len(links), -1)
    for k in range(len(links)):
        if part[k] < 0:
            part[k], front = k, np.array([k])
            while len(front):
                front = np.nonzero(links[front].any(axis=0) & (part < 0))[0]
                part[front] = k
    return part


def _unit(data: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _class_rows(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Usable vectors as (vec_id, class, data)."""
    kind = "f8" if vectors.schema["embedding"].dataType.elementType == T.DoubleType() else "f4"

    def packed(batches):
        for batch in batches:
            data = []
            for v in batch.column("embedding"):
                x = np.array(v.as_py(), kind) if v.is_valid and not any(e is None for e in v.as_py()) else np.zeros(0)
                data.append((x + 0.0).astype(kind).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(data, pa.binary())], ["vec_id", "data"])

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(packed, "vec_id long, data binary")
    return rows.withColumn("class", F.when(F.col("data").isNotNull(), F.unhex(F.sha2("data", 256)))), kind


def near(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; vectors of different lengths are never linked.

    Null, empty or zero vectors, and those with null or non-finite parts, link with nothing. Rows with a null vec_id take
    part; their component_id is the smallest id of their group, or null, and kept is null. Rows that share a vec_id are rows
    like others.
    """
    spark = vectors.sparkSession
    base.short_batches(spark)
    rows, kind = _class_rows(vectors)
    rows = base.settle(rows, "vectors")
    classes = base.settle(rows.where("class is not null").groupBy("class").agg(F.first("data").alias("data"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).withColumn("width", F.octet_length("data")), "vector_classes")
    edges = None
    for (width,) in classes.select("width").distinct().collect():  # one length, as a rule
        found = _leaf_links(classes.where(F.col("width") == width), kind, threshold)
        edges = found if edges is None else edges.unionByName(found)
    edges = spark.createDataFrame([], "a binary, b binary") if edges is None else edges
    parts = base.settle(base.components(edges).toDF("class", "part"), "parts")
    counts = _count_links(classes.join(parts, "class"), kind, threshold)
    named = classes.select("class", "vec_id", "copies").join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    least = named.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    known = named.join(least, "part").join(counts, "class", "left").selectExpr("class", "component_id", "coalesce(n, 0) + copies - 1 as n_links")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "class").join(known, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _leaf_links(classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Links (a, b) that tie the linked vectors of each leaf together."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.where(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < int(min(1, SAMPLE / n) * (1 << 30))).select("data").toArrow()["data"].to_pylist()
    depth = max(0, int(np.ceil(np.log2(n / UPPER_LEAF))))
    trees = []
    if sample:
        x = _unit(sample, kind)
        trees = [grow(x, depth, np.random.default_rng(k)) for k in range(TREES)]
    shared = spark.sparkContext.broadcast(trees or [None] * TREES)

    def routed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("data").to_pylist(), kind)
            for k, tree in enumerate(shared.value):
                for leaf, at in route(tree, x, np.arange(len(x))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), (k << 40) + leaf)), *(batch.column(c).take(pa.array(at)) for c in ("class", "data"))], ["leaf", "class", "data"])

    def linked(key, rows):
        x = _unit(rows["data"].tolist(), kind)
        names = rows["class"].to_numpy()
        a, b = [], []
        for at in leaves(x, np.random.default_rng(int(key[0]) % (1 << 32))):
            part = unite(x[at] @ x[at].T >= threshold)
            on = part != np.arange(len(part))
            a += names[at[part[on]]].tolist()
            b += names[at[on]].tolist()
        return pd.DataFrame({"a": a, "b": b}, dtype=object).drop_duplicates()

    rows = _within_bounds(classes.select("class", "data").mapInArrow(routed, "leaf long, class binary, data binary"), kind)
    return rows.groupBy("leaf").applyInPandas(linked, "a binary, b binary")


def _within_bounds(rows: DataFrame, kind: str) -> DataFrame:
    """leaf, class, data with every leaf of more than MOST vectors split, at quantiles of their own projections and with the same
    overlap, until none is: what the sample can't resolve is resolved by all vectors. Vectors of equal projections part by chance."""

    def projected(batches):
        for batch in batches:
            leaf, p = batch.column("leaf").to_numpy(), np.zeros(batch.num_rows)
            for k in np.unique(leaf):
                at = np.flatnonzero(leaf == k)
                x = _unit(batch.column("data").take(pa.array(at)).to_pylist(), kind)
                p[at] = x @ np.random.default_rng(int(k) % (1 << 63)).standard_normal(x.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], ["leaf", "class", "data", "p"])

    while True:
        large = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("leaf")
        if large.isEmpty():
            return rows
        jitter = F.xxhash64("class", "leaf").cast("double") * 1e-26
        wide = rows.join(large, "leaf").mapInArrow(projected, "leaf long, class binary, data binary, p double").withColumn("p", F.col("p") + jitter)
        wide = base.settle(wide, "wide-leaves")
        ends = wide.groupBy("leaf").agg(F.percentile_approx("p", [0.5 - SPILL / 2, 0.5 + SPILL / 2], 10_000).alias("ends"))
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("ends")[1], F.lit(0)), F.when(F.col("p") >= F.col("ends")[0], F.lit(1))))
        parts = wide.join(ends, "leaf").select(F.explode(sides).alias("side"), "leaf", "class", "data").select(F.xxhash64("leaf", "side").alias("leaf"), "class", "data")
        rows = base.settle(rows.join(large, "leaf", "left_anti").unionByName(parts), "leaves")


def _count_links(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(class, n): linked vectors of other classes, from all members of each part, block against block."""
    sizes = members.groupBy("part").agg(F.count("*").alias("size"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.lit(8), F.ceil(F.col("size") / 64))).cast("int")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = members.join(sizes.withColumn("blocks", blocks), "part").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Small groups share tasks: up to 1000 hash keys for each power of two of the group count.
    few = F.col("blocks") == 1
    dealt = dealt.withColumn("task", F.when(few, F.pmod(F.xxhash64("part"), F.lit(997))).otherwise(F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other"))))

    def counted(rows):
        rows = rows.sort_values(["part", "own", "class"], kind="stable")
        x, copies, own = _unit(rows["data"].tolist(), kind), rows["copies"].to_numpy(), rows["own"].to_numpy()
        low, high = np.minimum(own, rows["other"]), np.maximum(own, rows["other"])
        key = pd.factorize(pd.MultiIndex.from_arrays([rows["part"], low, high]))[0]
        n = np.zeros(len(rows), np.int64)
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
        for s, e in zip(bounds, bounds[1:], strict=False):
            at = order[s:e]
            left, right = at[own[at] == own[at].min()], at[own[at] == own[at].max()]
            on = x[left] @ x[right].T >= threshold
            if own[left[0]] == own[right[0]]:
                np.fill_diagonal(on, False)
                n[left] = on @ copies[right]
            else:
                n[left], n[right] = on @ copies[right], on.T @ copies[left]
        return pd.DataFrame({"class": rows["class"], "n": n})

    return dealt.select("task", "part", "own", "other", "class", "data", "copies").groupBy("task").applyInPandas(counted, "class binary, n long").groupBy("class").agg(F.sum("n").alias("n"))

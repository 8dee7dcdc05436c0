"""Source divergence audit: each group's term counts as a segment tree, equal subtrees shared, pairs of trees walked together.

Term ids of a language go by falling frequency, so rare terms, whose counts are mostly equal, lie side by side. The tree over all ids
is cut into aligned blocks of ``BLOCK`` ids; a task builds one block's subtrees of up to two tiles of groups. Subtrees with equal
counts are one node, whatever the group. Two groups' subtrees are then walked at the same time, level by level: each distinct pair of
nodes is taken once, and its price, the sum of absolute differences below it, is the sum of its two children's. Above the blocks a
price is a plain sum, which Spark adds up. The same walk against the language's own tree finds a group's terms of largest surplus,
going down only where the largest below a node pair can still be among them.

Counts are exact: 64 bits, with wider integers where 10^9 times a count needs them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from . import base
from .terms import Terms

#: Documents of a language that a term is in, added counts, the whole of a distribution, terms listed for a group.
MIN_DOCS, ADDED, WHOLE, LISTED = 30, 5, 1_000_000_000, 50
#: Term ids of a block (a power of two), groups of a tile.
BLOCK, TILE = 1024, 128
#: Counts that a task gathers before it hands them on.
GATHERED = 400_000

TERMS = Terms(digits=False)


def _named(docs: DataFrame) -> DataFrame:
    given = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("text", "lang", "source")}
    return docs.select(F.coalesce(given["lang"], F.lit("")).alias("lang"), F.coalesce(given["source"], F.lit("")).alias("source"), given["text"].cast("binary").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    seen = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            n = len(counts)
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = TERMS.counted(text.as_py())
            seen -= len(counts)
            counts.update(found)
            docs.update(found.keys())
            seen += len(counts)
        if seen >= GATHERED:
            yield from out()
            seen = 0
    yield from out()
    base.give_back()


def counts_of(docs: DataFrame) -> DataFrame:
    """lang, source, term (text), n and docs: how often a group's texts hold a term, and how many of them."""
    base.short_batches(docs.sparkSession)
    each = _named(docs).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


class Trees:
    """Segment trees over one block of ids, for several groups; equal subtrees are one node."""

    def __init__(self, counts: np.ndarray):
        """counts: groups x ids, a power of two of ids."""
        self.leaves, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.left, self.right = [], []  # by level, from above the leaves to the roots
        while nodes.shape[1] > 1:
            pairs, inverse = np.unique(nodes[:, 0::2].astype(np.int64) << 32 | nodes[:, 1::2], return_inverse=True)
            self.left.append(pairs >> 32)
            self.right.append(pairs & 0xFFFFFFFF)
            nodes = inverse.reshape(nodes.shape[0], -1)
        self.roots = nodes[:, 0]

    def walk(self, a: int, b: int) -> tuple[list, tuple[np.ndarray, np.ndarray]]:
        """(steps from the roots down, distinct leaf pairs): a step has, for each node pair, which pairs its children are."""
        u, v, steps = self.roots[[a]], self.roots[[b]], []
        for left, right in zip(reversed(self.left), reversed(self.right), strict=True):
            below = np.concatenate([left[u] << 32 | left[v], right[u] << 32 | right[v]])
            pairs, inverse = np.unique(below, return_inverse=True)
            steps.append((inverse[: len(u)], inverse[len(u) :]))
            u, v = pairs >> 32, pairs & 0xFFFFFFFF
        return steps, (u, v)


def shares(leaves: np.ndarray, n: int, terms: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / (n + ADDED * terms)) of each distinct count, exactly. Counts above n, which are other
    groups', are never asked for."""
    whole, held = n + ADDED * terms, np.minimum(leaves, n)
    if not whole:
        return np.ones(len(leaves), np.int64)
    if n < (1 << 62) // WHOLE:
        return 1 + WHOLE * (held + ADDED) // whole
    return 1 + (WHOLE * (held.astype(object) + ADDED) // whole).astype(np.int64)


def price(trees: Trees, a: int, b: int, p: np.ndarray, q: np.ndarray) -> int:
    """Sum of absolute differences between two trees: each distinct pair of nodes is priced once. p, q: shares by leaf."""
    steps, (u, v) = trees.walk(a, b)
    cost = np.abs(p[u] - q[v])
    for left, right in reversed(steps):
        cost = cost[left] + cost[right]
    return int(cost[0])


def surplus(trees: Trees, a: int, b: int, p: np.ndarray, q: np.ndarray, listed: int) -> list[tuple[int, int]]:
    """(id, p - q) of the ids that a holds and whose surplus over b is above 0 and, but for ties, among the ``listed`` largest."""
    steps, (u, v) = trees.walk(a, b)
    most = [np.where(trees.leaves[u] > 0, p[u] - q[v], 0)]
    for left, right in reversed(steps):
        most.append(np.maximum(most[-1][left], most[-1][right]))
    ids, nodes = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for (left, right), below in zip(steps, reversed(most[:-1]), strict=True):
        ids, nodes = np.concatenate([2 * ids, 2 * ids + 1]), np.concatenate([left[nodes], right[nodes]])
        least = max(1, np.partition(below[nodes], -listed)[-listed] if len(nodes) > listed else 1)
        kept = below[nodes] >= least
        ids, nodes = ids[kept], nodes[kept]
    values = most[0][nodes]
    return [(int(k), int(x)) for k, x in zip(ids, values, strict=True) if x > 0]


_RESULT = "lang string, part string, source string, item string, value long"


def _block(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One block of a language, for the groups of one tile or two. cells: at, source (null: the language), n, term. groups: source,
    tile, total, terms, of the language as well (null)."""
    groups = groups.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
    row = {None if pd.isna(s) else s: k for k, s in enumerate(groups["source"])}
    counts = np.zeros((len(groups), BLOCK), np.int64)
    lang, used = groups["lang"][0], 0
    names: dict[int, str] = {}
    for at, source, n, term in cells[["at", "source", "n", "term"]].itertuples(index=False):
        source = None if pd.isna(source) else source
        if source in row:
            counts[row[source], at] = n
        if source is None:
            names[at] = term
            used = max(used, at + 1)
    trees = Trees(counts)
    p = [shares(trees.leaves, int(n), int(v)) for n, v in zip(groups["total"], groups["terms"], strict=True)]
    # Ids beyond the last term count 0 everywhere: what they would cost is taken off.
    beyond = BLOCK - used
    zero = int(np.searchsorted(trees.leaves, 0))
    own = row.get(None)
    first, second = groups["pair"][0].split("-")
    out = []
    for a in range(len(groups)):
        for b in range(a + 1, len(groups)):
            if own in (a, b) or first != second and groups["tile"][a] == groups["tile"][b]:
                continue
            cost = price(trees, a, b, p[a], p[b]) - beyond * abs(int(p[a][zero] - p[b][zero])) if used else 0
            out.append((lang, "pair", groups["source"][a], groups["source"][b], cost))
        if first == second and a != own and used:
            found = sorted(((-x, names[k].encode(), names[k]) for k, x in surplus(trees, a, own, p[a], p[own], LISTED)))
            out += [(lang, "term", groups["source"][a], term, -x) for x, _, term in found[:LISTED]]
    return pd.DataFrame(out, columns=["lang", "part", "source", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source; null counts as '').

    Part ``pair``: each other source of the language with the sum of absolute differences of shares over the language's kept terms
    (0 where none is kept). Part ``term``: the first 50 kept terms that the group holds and whose share exceeds the language's.
    Ranks go by falling value, then item. A group without terms has all its shares from the added counts; a language with one source
    has no pairs. Repeated rows count again; other columns do not matter; no documents give no rows.
    """
    counts = base.settle(counts_of(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    kept = base.settle(numbered(kept, [F.desc("all"), F.col("term")], "place", ["lang"]).select("lang", "term", "all", F.expr(f"(place - 1) div {BLOCK}").alias("block"), F.expr(f"cast((place - 1) % {BLOCK} as int)").alias("at")), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    # A language's kept terms with their counts in each group; terms in every source are as many rows as there are sources.
    cells = base.settle(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "block", "at", "n"), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _named(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs.drop("lang_total"), "lang", "left").fillna(0, ["total", "terms"])
    groups = base.settle(numbered(groups, ["source"], "place", ["lang"]).withColumn("tile", F.expr(f"(place - 1) div {TILE}")).drop("place"), "groups")
    tiles = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"), F.max("terms").alias("terms"))
    # A tile meets itself and each other one: a group goes to as many tasks of a block as there are tiles.
    meets = F.explode(F.transform(F.expr("sequence(0L, tiles - 1)"), lambda t: F.concat(F.least(t, "tile").cast("string"), F.lit("-"), F.greatest(t, "tile").cast("string")))).alias("pair")
    blocks = F.explode(F.expr(f"sequence(0L, greatest(terms - 1, 0L) div {BLOCK})")).alias("block")
    spread = groups.join(tiles.drop("terms"), "lang").select("lang", "source", "tile", "total", "terms", meets)
    selves = tiles.join(langs.drop("terms"), "lang", "left").select("lang", F.lit(None).cast("string").alias("source"), F.lit(-1).cast("long").alias("tile"), F.coalesce("lang_total", F.lit(0)).alias("total"), "terms", "tiles")
    pairs = F.expr("explode(flatten(transform(sequence(0L, tiles - 1), i -> transform(sequence(i, tiles - 1), j -> concat(string(i), '-', string(j))))))").alias("pair")
    members = spread.unionByName(selves.select("lang", "source", "tile", "total", "terms", pairs)).select("*", blocks)
    held = cells.join(groups.select("lang", "source", "tile"), ["lang", "source"]).join(tiles.select("lang", "tiles"), "lang").select("lang", "source", "term", "block", "at", "n", meets)
    whole = kept.join(tiles.select("lang", "tiles"), "lang").select("lang", F.lit(None).cast("string").alias("source"), "term", "block", "at", F.col("all").alias("n"), pairs)
    keys = "lang", "block", "pair"
    priced = held.unionByName(whole).groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(_block, _RESULT)
    priced = base.settle(priced, "priced")
    each = priced.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = each.unionByName(each.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = priced.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return both.withColumn("rank", F.row_number().over(order)).select(columns).unionByName(first.select(columns))

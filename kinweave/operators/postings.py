"""A full-text index of postings in blocks of rows, kept up to date by delta segments.

A segment has, for each token, column and block of keys, which rows hold the token and where, with the block's largest count and its
shortest row; the rows it wrote; and the keys that it took over from earlier segments. A common token has as many blocks as there are
ranges of keys, so no task holds all its postings. A refresh writes a segment for the changed rows alone; postings of their earlier
versions are dead from then on. Segments of one level are merged when there are several. Manifests, committed by number, say which
segments an index has, in order, and how many rows and tokens are alive.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import catalog
from ..sources.scratch import drop, settle

#: Keys of a block, segments of one level that are merged, blocks that are ranked first, postings that a task groups.
SPAN, FAN, SEEDS, POSTS = 16_384, 4, 8, 500_000


def scored(row: DataFrame, phrases: int, any_of: bool, key: str, rows: int | None = None, mean: float | None = None) -> DataFrame:
    """key and rank (BM25, lower is better) from key, len and the frequencies f0, f1 and so on of the phrases. rows and mean of the
    whole corpus, if row has only a part of it."""
    counts = [F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(phrases)]
    stats = row.agg(F.count("*").alias("rows"), F.avg("len").alias("mean"), *counts).first()
    idf = [_idf(stats["rows"] if rows is None else rows, stats[f"n{k}"]) for k in range(phrases)]
    return _weighed(row, idf, stats["mean"] if mean is None else mean, any_of).select(key, "rank")


def _idf(rows: int, n: int) -> Column:
    idf = F.log((F.lit(rows) - F.lit(n) + 0.5) / (F.lit(n) + 0.5))
    return F.when(idf > 0, idf).otherwise(1e-6)


def _part(idf: Column, f: Column, length: Column, mean: float | None) -> Column:
    return idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / F.lit(mean or 1.0)))


def _weighed(row: DataFrame, idf: Sequence[Column], mean: float | None, any_of: bool) -> DataFrame:
    on = [F.col(f"f{k}") > 0 for k in range(len(idf))]
    kept = reduce(lambda a, b: a | b, on, F.lit(False)) if any_of else reduce(lambda a, b: a & b, on, F.lit(True))
    score = F.lit(0.0)
    for k, weight in enumerate(idf):
        score = score - _part(weight, F.col(f"f{k}"), F.col("len"), mean)
    return row.where(kept).withColumn("rank", score)


@dataclass
class Index:
    """An index as one manifest has it. segments: name and level, oldest first; rows and tokens: how many are alive."""

    spark: SparkSession
    path: str
    number: int
    key: str
    columns: list[str]
    segments: list[dict] = field(default_factory=list)
    rows: int = 0
    tokens: int = 0

    @property
    def mean(self) -> float | None:
        return self.tokens / self.rows if self.rows else None

    def part(self, name: str, within: Sequence[int] | None = None) -> DataFrame:
        """A table (postings, rows or gone) of all segments, or of some, with ``seg``, the segment's place."""
        schema = {"postings": "token string, column string, block long, keys array<long>, places array<array<int>>, sizes array<int>, most int, shortest int", "rows": "key long, len int", "gone": "key long"}[name]
        at = range(len(self.segments)) if within is None else within
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/segments/{self.segments[k]['name']}/{name}").withColumn("seg", F.lit(k)) for k in at]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], f"{schema}, seg int")

    def alive(self, rows: DataFrame) -> DataFrame:
        """The rows (key, seg) that no later segment took over."""
        if len(self.segments) < 2:
            return rows
        taken = self.part("gone", range(1, len(self.segments))).groupBy("key").agg(F.max("seg").alias("_taken"))
        return rows.join(taken, "key", "left").where(F.col("_taken").isNull() | (F.col("_taken") <= F.col("seg"))).drop("_taken")


def _placed(tokens: Column) -> Column:
    """array<struct<token, places>> of an array's distinct tokens: token and place are sorted within the row, then cut where the token changes."""
    pairs = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("place"))))

    def cut(held: Column) -> Column:
        token = lambda i: F.get(held, i)["token"]
        starts = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (token(i) != token(i - 1)))
        places = lambda i, end: F.transform(F.slice(held, i + 1, end - i), lambda x: x["place"])
        runs = lambda at: F.transform(at, lambda i, k: F.struct(token(i).alias("token"), places(i, F.coalesce(F.get(at, k + 1), F.size(held))).alias("places")))
        return F.when(F.size(held) > 0, F.get(F.transform(F.array(starts), runs), F.lit(0)))

    # Arrays are bound to variables: inlined into the lambdas, they would be made anew for each token.
    return F.coalesce(F.get(F.transform(F.array(pairs), cut), F.lit(0)), F.array().cast("array<struct<token:string,places:array<int>>>"))


def _write(corpus: DataFrame, columns: Sequence[str], key: str, path: str) -> tuple[int, int]:
    """Writes a segment's postings and rows; gives how many rows and tokens it has. A row's postings are made within the row, so only
    they are shuffled, once, to where they lie in the order of tokens."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), _placed(X.tokens(F.col(c))).alias("posts")) for c in columns))
    cut = corpus.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), each.alias("x"))
    total = lambda of: F.aggregate("x", F.lit(0), lambda n, x: n + of(x["posts"]))
    cut = settle(cut.withColumn("len", total(lambda posts: F.aggregate(posts, F.lit(0), lambda n, p: n + F.size(p["places"])))), "cut")
    sums = cut.agg(F.count("*"), F.sum("len"), F.sum(total(F.size))).first()
    held = cut.select("key", "len", F.explode("x").alias("x")).select("key", "len", "x.column", F.inline("x.posts"))
    _blocks(held, sums[2] or 0).write.parquet(f"{path}/postings")
    cut.select("key", "len").write.parquet(f"{path}/rows")
    drop(cut)
    return sums[0], sums[1] or 0


def _blocks(held: DataFrame, made: int) -> DataFrame:
    """token, column, key, len, places (made of them, about) in blocks of keys, in files by ranges of tokens."""
    # What a range of tokens holds is grouped where it lies: one shuffle, and tasks that stay as large when the corpus grows.
    dealt = held.withColumn("block", F.floor(F.col("key") / SPAN)).repartitionByRange(max(1, -(-made // POSTS)), "token", "block")
    rows = F.sort_array(F.collect_list(F.struct("key", "places", "len"))).alias("rows")  # a block's keys at most
    grouped = dealt.groupBy("token", "column", "block").agg(rows, F.max(F.size("places")).alias("most"), F.min("len").alias("shortest"))
    return grouped.select("token", "column", "block", F.col("rows.key").alias("keys"), F.col("rows.places").alias("places"), F.col("rows.len").alias("sizes"), "most", "shortest").sortWithinPartitions("token", "block")


def _content(index: Index) -> dict:
    return {"key": index.key, "columns": index.columns, "segments": index.segments, "rows": index.rows, "tokens": index.tokens}


def opened(spark: SparkSession, path: str) -> Index:
    """The index as it is now; LookupError if there is none."""
    number, content = catalog.latest(spark, path)
    if not number:
        raise LookupError(f"no index in {path}")
    return Index(spark, path, number, **content)


def indexed(corpus: DataFrame, columns: Sequence[str], path: str, key: str = "id") -> Index:
    """Writes the index of a corpus (a long key, text columns) under path. Rows with a null key are left out; keys are different."""
    name = f"{uuid.uuid4().hex}"
    rows, tokens = _write(corpus, columns, key, f"{path}/segments/{name}")
    index = Index(corpus.sparkSession, path, 1, key, list(columns), [{"name": name, "level": 0}], rows, tokens)
    if not catalog.commit(corpus.sparkSession, path, 1, _content(index)):
        raise FileExistsError(f"there is an index in {path}")
    return index


def refresh(index: Index, changed: DataFrame, gone: DataFrame | None = None) -> Index:
    """The index after changed rows (key and columns, in place of their earlier versions) and deleted ones (gone: key).

    Only the changed rows are read and written; sums move by what they had and have. Where another writer committed meanwhile, its
    segments come first. The same refresh again changes nothing.
    """
    spark, key = index.spark, index.key
    name = f"{uuid.uuid4().hex}"
    path = f"{index.path}/segments/{name}"
    rows, tokens = _write(changed, index.columns, key, path)
    keys = changed.select(F.col(key).cast("long").alias("key"))
    if gone is not None:
        keys = keys.unionByName(gone.select(F.col(key).cast("long").alias("key")))
    keys.where("key is not null").distinct().write.parquet(f"{path}/gone")
    touched = spark.read.schema("key long").parquet(f"{path}/gone")
    while True:
        now = opened(spark, index.path)
        old = now.alive(now.part("rows")).join(touched, "key", "left_semi").agg(F.count("*"), F.sum("len")).first()
        new = Index(spark, index.path, now.number + 1, key, now.columns, [*now.segments, {"name": name, "level": 0}], now.rows + rows - old[0], now.tokens + tokens - (old[1] or 0))
        if catalog.commit(spark, index.path, new.number, _content(new)):
            return merged(new)


def merged(index: Index) -> Index:
    """The index with runs of ``FAN`` segments or more of one level merged into one of the next, dead postings dropped; another writer's
    commit in between ends the attempt, and the next refresh takes it up."""
    while True:
        levels = [s["level"] for s in index.segments]
        start = next((k for k in range(len(levels) - FAN + 1) if len({*levels[k : k + FAN]}) == 1), None)
        if start is None:
            return index
        end = start
        while end < len(levels) and levels[end] == levels[start]:
            end += 1
        run, name = range(start, end), f"{uuid.uuid4().hex}"
        path = f"{index.path}/segments/{name}"
        posts = index.part("postings", run).select("token", "column", "seg", F.explode(F.arrays_zip("keys", "places", "sizes")).alias("r")).select("token", "column", "seg", F.col("r.keys").alias("key"), F.col("r.places").alias("places"), F.col("r.sizes").alias("len"))
        _blocks(index.alive(posts), index.tokens).write.parquet(f"{path}/postings")
        index.alive(index.part("rows", run)).select("key", "len").write.parquet(f"{path}/rows")
        if start:  # what older segments have of these keys stays dead
            index.part("gone", run).select("key").distinct().write.parquet(f"{path}/gone")
        segments = [*index.segments[:start], {"name": name, "level": levels[start] + 1}, *index.segments[end:]]
        new = Index(index.spark, index.path, index.number + 1, index.key, index.columns, segments, index.rows, index.tokens)
        if not catalog.commit(index.spark, index.path, new.number, _content(new)):
            return opened(index.spark, index.path)
        index = new


def _of(index: Index, token: str, last: bool, allowed: Sequence[str] | None) -> DataFrame:
    of = index.part("postings").where(F.col("token").startswith(token) if last else F.col("token") == token)
    return of.where(F.col("column").isin(*allowed)) if allowed else of


def _entries(blocks: DataFrame) -> DataFrame:
    return blocks.select("column", "seg", F.explode(F.arrays_zip("keys", "places", "sizes")).alias("r")).select("column", "seg", F.col("r.keys").alias("key"), F.col("r.places").alias("places"), F.col("r.sizes").alias("len"))


def _frequencies(index: Index, phrases: Sequence[Sequence[str]], allowed: Sequence[str] | None, only: DataFrame | None = None) -> DataFrame:
    """key, len, f0, f1 and so on of the living rows with a phrase; only: blocks (block) to look into."""
    hits = None
    for k, phrase in enumerate(phrases):
        here = None
        for j, token in enumerate(phrase):
            of = _of(index, token, j + 1 == len(phrase), allowed)
            of = index.alive(_entries(of if only is None else of.join(only, "block", "left_semi")))
            # A phrase's tokens stand side by side: each place is told by where the phrase would begin.
            at = of.select("key", "len", "column", F.explode("places").alias("at")).withColumn("at", F.col("at") - j) if len(phrase) > 1 else of.select("key", "len", F.size("places").alias("n"))
            here = at if here is None else here.join(at.drop("len"), ["key", "column", "at"])
        n = (here.distinct() if len(phrase) > 1 else here).groupBy("key").agg((F.count("*") if len(phrase) > 1 else F.sum("n")).alias(f"f{k}"), F.min("len").alias(f"len{k}"))
        hits = n if hits is None else hits.join(n, "key", "outer")
    return hits.select("key", F.coalesce(*(f"len{k}" for k in range(len(phrases)))).alias("len"), *(F.coalesce(f"f{k}", F.lit(0)).alias(f"f{k}") for k in range(len(phrases))))


def found(index: Index, phrases: Sequence[Sequence[str]], allowed: Sequence[str] | None = None, any_of: bool = False) -> DataFrame:
    """key and rank of all rows with all phrases, or any of them: only the postings of the phrases' tokens are read."""
    row = settle(_frequencies(index, phrases, allowed), "frequencies")
    return scored(row, len(phrases), any_of, "key", index.rows, index.mean).withColumnRenamed("key", index.key)


def best(index: Index, phrases: Sequence[Sequence[str]], limit: int, allowed: Sequence[str] | None = None, any_of: bool = False) -> DataFrame:
    """The first ``limit`` rows of ``found`` by rank, then key, without ranking blocks that cannot have one of them.

    A block's largest count and shortest row bound what its rows can score. A few blocks of the highest bounds are ranked first; their
    limit-th rank says which others are left out. How many rows hold a token comes from the blocks' keys, places unread. Phrases of
    several tokens have no such bound: they are ranked whole.
    """
    if any(len(p) > 1 for p in phrases):
        return found(index, phrases, allowed, any_of).orderBy("rank", index.key).limit(limit)
    bounds, idf = None, []
    for k, (token,) in enumerate(phrases):
        of = _of(index, token, True, allowed)
        held = index.alive(of.select("seg", F.explode("keys").alias("key")))
        idf.append(_idf(index.rows, held.agg(F.count_distinct("key")).first()[0]))
        # Tokens, columns and segments of a block add up.
        of = of.groupBy("block").agg(F.sum("most").alias("f"), F.min("shortest").alias("len"))
        of = of.select("block", _part(idf[k], F.col("f"), F.col("len"), index.mean).alias(f"b{k}"))
        bounds = of if bounds is None else bounds.join(of, "block", "outer" if any_of else "inner")
    bound = sum((F.coalesce(f"b{k}", F.lit(0.0)) for k in range(len(phrases))), F.lit(0.0))
    bounds = settle(bounds.select("block", bound.alias("bound")), "bounds")

    def ranks(blocks: DataFrame) -> DataFrame:
        return _weighed(_frequencies(index, phrases, allowed, blocks.select("block")), idf, index.mean, any_of).select("key", "rank").orderBy("rank", "key").limit(limit)

    seeds = ranks(bounds.orderBy(F.desc("bound")).limit(SEEDS)).agg(F.count("*"), F.max("rank")).first()
    # Rounding may lift a score over its bound by a few units in the last place.
    live = bounds.where(F.col("bound") * (1 + 1e-9) >= -seeds[1]) if seeds[0] == limit else bounds
    return ranks(live).withColumnRenamed("key", index.key)

"""Language model scores from a hierarchical Pitman-Yor process over whole words.

Every word of the corpus is a context of its own: the words that follow it are the dishes of its restaurant. All restaurants
share the parent restaurant of single words, whose base is uniform over the words and the unknown one. Customers of the
parent are the children's tables. Seating starts one customer after another and is sampled by Gibbs sweeps in which every
customer gets up once and sits down given all others; predictive probabilities are averaged over the sweeps after burn-in.

Texts become slices: packed token codes over the slice's own words, read instead of texts from then on. Parts, each with a range of
64-bit digests, number the words; from then on numbers stand for them. Contexts are dealt over shards by number, a frequent
one over several shards by the word that follows. A slice sends a shard each of its word pairs once, with their count; these rows are
kept and read again for the scores. Shards and parts tell each other tables and chances after each sweep, and answer the
slices in the end. All of these are rows of one form, (home, kind, peer, a to e), that Spark shuffles by home: a group is one
slice, shard or part of bounded size.

What is not sequential: dishes of a shard move side by side, a customer of each at a time, and see each other's tables from the
step before; a dish with more than BATCHES customers moves a BATCHES-th of them at a time; shards see the parent from the sweep before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Discount and strength of all restaurants.
DISCOUNT, STRENGTH = 0.75, 1.0
#: Sweeps before and of the average; moves of a dish in a sweep, each of one customer or, beyond so many, of an equal share.
BURN_IN, SAMPLES, BATCHES = 3, 3, 128
#: Tokens of a slice and of a shard, about.
SLICE_TOKENS, SHARD_TOKENS = 1_500_000, 2_000_000
#: Parts of a shard's tokens from which a context is dealt over several.
HOT = 4
#: Stands for the end of a text.
END = 0

_ROW = "home long, kind string, peer long, x long, y long, a binary, b binary, c binary, d binary, e binary"
_FIELDS = ["home", "kind", "peer", "x", "y", "a", "b", "c", "d", "e"]
_TYPES = pa.schema([("home", pa.int64()), ("kind", pa.string()), *((k, pa.int64()) for k in ("peer", "x", "y")), *((k, pa.binary()) for k in "abcde")])


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text; where it begins or ends with spaces, an empty one there."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


def tokens(lists: list[pa.ListArray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the distinct words and of the end, ascending, codes of all texts' words and ends among them, and how many each text has."""
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    ids, empty = ids_of(coded.dictionary)
    codes = coded.indices.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([x.value_lengths().to_numpy() for x in lists]))])
    if len(empty):
        real = codes != empty[0]
        codes, bounds = codes[real], np.append(0, np.cumsum(real))[bounds]
    ids, place = np.unique(np.append(ids, np.uint64(END)), return_inverse=True)
    return ids, np.insert(place.astype(np.uint32)[codes], bounds[1:], 0), np.diff(bounds) + 1  # the end is the first word


def ids_of(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of words, and where the empty one stands, whose digest is the end's."""
    words = words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ids[ids == END] = 1
    empty = np.flatnonzero(words == b"")
    ids[empty] = END
    return ids, empty


def pack(x: np.ndarray, kind: str = "u4") -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    if not len(x):
        return bytes(8)
    raw = np.ascontiguousarray(x, f"<{kind}").view(np.uint8).reshape(len(x), -1)
    planes = np.empty(raw.shape[::-1], np.uint8)
    for k, plane in enumerate(planes):  # many times as fast as the whole transposed
        plane[:] = raw[:, k]
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: str = "u4") -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, f"<{kind}")
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    raw = np.empty((n, width), np.uint8)
    for k, plane in enumerate(planes):
        raw[:, k] = plane
    return raw.view(f"<{kind}").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(np.asarray(x, np.uint64), prepend=np.uint64(0)), "u8")


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "u8"), dtype=np.uint64)


# --- seating ---


def _changed(size: np.ndarray, at: np.ndarray, by: int, once: bool) -> np.ndarray:
    """Tables with ``by`` more customers for each time that they are named; once: none is named twice."""
    if not once:
        return size + by * np.bincount(at, minlength=len(size))
    size = size.copy()
    size[at] += by
    return size


def step(of: np.ndarray, size: np.ndarray, seated: np.ndarray, leave: np.ndarray | None, join: np.ndarray, chance: np.ndarray, context: np.ndarray, opened: np.ndarray, random) -> tuple[np.ndarray, np.ndarray]:
    """Of each dish, ``leave`` of its ``seated`` customers get up, drawn evenly, then ``join`` sit down given all who sit.

    of, size: dish (ascending) and customers of each table. chance: the parent's of each dish. context: the restaurant of each
    dish. opened: tables of each restaurant, kept up to date.
    """
    dishes = np.arange(len(seated))
    one = join.max(initial=1) == 1  # as a rule
    who = dishes if one and join.all() else np.repeat(dishes, join)
    if leave is not None:
        first = np.cumsum(seated) - seated
        one = one and leave.max(initial=1) == 1
        if one and leave.all():
            at = first + (random.random(len(seated)) * seated).astype(np.int64)
        else:
            up = np.repeat(dishes, leave)
            nth = np.arange(len(up)) - np.repeat(np.cumsum(leave) - leave, leave)
            at = first[up] + ((random.random(len(seated))[up] + nth) * seated[up] / leave[up]).astype(np.int64)
        size = _changed(size, np.searchsorted(np.cumsum(size), at, side="right"), -1, one)
        empty = size == 0
        np.subtract.at(opened, context[of[empty]], 1)
        of, size, seated = of[~empty], size[~empty], seated - leave
    tables = np.bincount(of, minlength=len(seated))
    ends = np.cumsum(tables)
    begins = ends - tables
    old = np.maximum(seated - DISCOUNT * tables, 0)
    new = (STRENGTH + DISCOUNT * opened[context]) * chance
    opens = random.random(len(who)) * (old + new)[who] < new[who]
    sits, fresh = who[~opens], who[opens]
    mass = np.cumsum(size - DISCOUNT)
    to = np.searchsorted(mass, np.concatenate([[0], mass])[begins[sits]] + random.random(len(sits)) * old[sits], side="right")
    size = _changed(size, np.clip(to, begins[sits], ends[sits] - 1), 1, one)
    np.add.at(opened, context[fresh], 1)
    return np.insert(of, ends[fresh], fresh), np.insert(size, ends[fresh], 1)


def sweep(n: np.ndarray, of: np.ndarray | None, size: np.ndarray | None, chance: np.ndarray, context: np.ndarray, opened: np.ndarray, random) -> tuple[np.ndarray, np.ndarray]:
    """Every customer moves once; without tables (of is None) all are seated one after another. n: customers of each dish, falling.

    A dish of two, as most are, has one table or two, which is all that its moves need to know; a customer alone comes back to a table alone.
    """
    fresh, done, less = of is None, [], -n
    of, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if fresh else (of, size)
    hot, many, several, some = np.searchsorted(less, [-BATCHES, -2, -1, 0])  # dishes with more customers than these, negated
    hot = min(hot, many)
    ends = np.searchsorted(of, [hot, many, several])
    two = np.bincount(of[ends[1] : ends[2]] - many, minlength=several - many) == 2
    of_pairs, chance_of_pairs = context[many:several], chance[many:several]
    above, sizes, of, size = of[: ends[0]], size[: ends[0]], of[ends[0] : ends[1]] - hot, size[ends[0] : ends[1]]
    seated, ones = np.zeros(many, np.int64) if fresh else n[:many], np.ones(many - hot, np.int64)
    for r in range(min(BATCHES, int(n[0]) if len(n) else 0)):
        if hot:
            moves = n[:hot] // BATCHES + (r < n[:hot] % BATCHES)
            above, sizes = step(above, sizes, seated[:hot], None if fresh else moves, moves, chance[:hot], context[:hot], opened, random)
            if fresh:
                seated[:hot] += moves
        k = min(many, np.searchsorted(less, -r)) - hot  # dishes with more than r customers
        if k > 0:
            cut, at = np.searchsorted(of, k), slice(hot, hot + k)
            done.append((of[cut:], size[cut:]))
            of, size = step(of[:cut], size[:cut], seated[at], None if fresh else ones[:k], ones[:k], chance[at], context[at], opened, random)
            if fresh:
                seated[at] += 1
        if fresh and r == 0:
            np.add.at(opened, context[many:some], 1)
        elif r < 2:
            if not fresh:
                np.subtract.at(opened, of_pairs[two], 1)
            new = (STRENGTH + DISCOUNT * opened[of_pairs]) * chance_of_pairs
            two = random.random(len(new)) * (1 - DISCOUNT + new) < new
            np.add.at(opened, of_pairs[two], 1)
    done.append((of, size))
    of, size = (np.concatenate([x[k] for x in reversed(done)]) for k in (0, 1))
    tables = np.concatenate([1 + two, np.ones(some - several, np.int64)])
    last = np.concatenate([2 - two, np.ones(some - several, np.int64)])
    return np.concatenate([above, of + hot, np.repeat(np.arange(many, some), tables)]), np.concatenate([sizes, size, np.repeat(last, tables)])


def _regrouped(of: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables under new numbers of their dishes."""
    moved = place[of]
    order = np.argsort(moved, kind="stable")
    return moved[order], size[order]


# --- rows ---


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{k: r.get(k) for k in _FIELDS} for r in rows], _TYPES)


def _grouped(frames: list[DataFrame], homes: int, function) -> DataFrame:
    """Rows of all frames by home; function gets a home and its rows by kind, each in order of peer, and gives rows."""

    def run(key, group):
        rows: dict[str, list[dict]] = {}
        for r in sorted(group.to_pylist(), key=lambda r: (r["kind"], r["peer"] or 0)):
            rows.setdefault(r["kind"], []).append(r)
        del group
        out = _table(list(function(key[0].as_py(), rows)))
        del rows
        base.give_back()
        return out

    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole.repartition(2 * homes, "home").groupBy("home").applyInArrow(run, _ROW)


def slices_of(docs: DataFrame, held_out: Column) -> DataFrame:
    """A row of kind slice for about SLICE_TOKENS tokens of a task: x tokens, y of them learned from; a words, b codes, c ids, d tokens
    of each text, e whether it is held out (1) or has no id (2)."""
    base.short_batches(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            ids, flags, lists = zip(*held, strict=True)
            (words, codes, sizes), flags = tokens(lists), np.concatenate(flags)
            row = {"home": uuid.uuid4().int >> 65, "kind": "slice", "x": len(codes), "y": int(sizes[flags & 1 == 0].sum())}
            row |= {"a": pack_sorted(words), "b": pack(codes), "c": pack(np.concatenate(ids), "i8"), "d": pack(sizes), "e": pack(flags, "u1")}
            held.clear()
            return _table([row]).to_batches()[0]

        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            flags = pc.fill_null(batch.column("held_out"), False).to_numpy(zero_copy_only=False) + 2 * ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = pc.fill_null(ids, 0).to_numpy()
            ends, b = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0
            while b < len(ends):
                a, b = b, max(b + 1, int(np.searchsorted(ends, (ends[b - 1] if b else 0) + 4_000_000, side="right")))
                held.append((ids[a:b], flags[a:b], words_of(texts.slice(a, b - a))))
                if sum(len(h[2].values) + len(h[0]) for h in held) >= SLICE_TOKENS:
                    yield row()
                    base.give_back()
        if held:
            yield row()

    return base.only(docs, "doc_id", "text").withColumn("held_out", held_out).mapInArrow(run, _ROW)


def _of_slices(parts: DataFrame, function) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _table(list(function(r))).to_batches()
                base.give_back()

    return parts.mapInArrow(run, _ROW)


@dataclass
class Layout:
    """How words and contexts are dealt: shards (and parts), the first word of each part, and the frequent contexts with the shards of each."""

    shards: int
    starts: np.ndarray  # of each part, and behind the last one the number of words
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def words(self) -> int:
        return max(1, int(self.starts[-1]))

    def shard(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        home = u % self.shards
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            often = np.flatnonzero(self.hot[at] == u)
            home[often] = (home[often] + w[often] % self.spread[at[often]]) % self.shards
        return home

    def by_shard(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of pairs by shard, within one as they come, and each shard's bounds in it."""
        home = self.shard(u, w).astype(np.uint16 if self.shards < 1 << 16 else np.int64)
        order = np.argsort(home, kind="stable")
        return order, np.concatenate([[0], np.cumsum(np.bincount(home, minlength=self.shards))])

    def by_part(self, words: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Each part that has some of the ascending words, and where they lie."""
        bounds = np.searchsorted(words, self.starts)
        return ((k, slice(bounds[k], bounds[k + 1])) for k in np.flatnonzero(np.diff(bounds)).tolist())


def _tokens(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """A slice's words, and each token's pair with the one before it, as u * words + w."""
    words, codes = unpack_sorted(r["a"]).view(np.int64), unpack(r["b"]).astype(np.int64)
    return words, np.append(0, codes[:-1]) * len(words) + codes  # the end is the first word, and stands before each text


def _asks(r: dict, layout: Layout) -> Iterator[dict]:
    """Rows of kind ask, to each shard: a pairs as u * all words + w, b counts."""
    words, token = _tokens(r)
    both = token * 2 + np.repeat(unpack(r["e"], "u1") & 1 == 0, unpack(r["d"]))
    both.sort()
    starts = np.flatnonzero(_runs(both >> 1))
    n = np.add.reduceat(both & 1, starts)
    u, w = np.divmod(both[starts] >> 1, len(words))
    u, w = words[u], words[w]
    order, ends = layout.by_shard(u, w)
    keys, n = (u * layout.words + w)[order], n[order]
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield {"home": k, "kind": "ask", "peer": r["home"], "a": pack_sorted(keys[ends[k] : ends[k + 1]]), "b": pack(n[ends[k] : ends[k + 1]])}


def _runs(x: np.ndarray) -> np.ndarray:
    """For sorted numbers: whether each is the first of its kind."""
    return np.append(True, x[1:] != x[:-1])[: len(x)]


def _merged(asks: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All pairs of a shard's asks, their counts, and where each ask's pairs lie among them."""
    keys = [unpack_sorted(r["a"]).view(np.int64) for r in asks]
    pairs = np.concatenate(keys)
    pairs.sort()
    pairs = pairs[_runs(pairs)]
    at = [np.searchsorted(pairs, k) for k in keys]
    n = np.zeros(len(pairs), np.int64)
    for r, k in zip(asks, at, strict=True):
        n[k] += unpack(r["b"])
    return pairs, n, at


@dataclass
class Corpus:
    """Slices whose words are numbered, all texts alike: those learned from and those only scored."""

    layout: Layout
    vocabulary: DataFrame  # rows of kind vocab: b the count of each word of a part; of kind place: a slice's words in a part
    slices: DataFrame  # rows of kind slice, with numbers for digests
    asks: DataFrame  # rows of kind ask
    total: int
    distinct: int


@dataclass
class Model:
    corpus: Corpus
    tables: list[float]  # of the parent, in each sample
    customers: list[float]
    hot_tables: list[np.ndarray]  # of the frequent contexts, in each sample
    vocabulary: DataFrame  # rows of kind vocab: the counts of a part's words
    dishes: DataFrame  # rows of kind dish: pairs of a shard that occur twice or more
    seats: list[DataFrame]  # rows of kind seats: tables of these, in each sample
    parents: list[DataFrame]  # rows of kind parent: c has what the parent's own tables give each word

    @property
    def floor(self) -> float:
        return 1 / (self.corpus.distinct + 1)

    def drop(self) -> None:
        """Deletes what scores do not read any more once they are asked for."""
        base.drop(self.corpus.vocabulary, self.vocabulary, self.dishes, *self.seats, *self.parents)


def _words(r: dict, homes: int) -> Iterator[dict]:
    """Rows of kind word, to each part, which has a range of digests: a the slice's words there, b their counts."""
    words, codes = unpack_sorted(r["a"]), unpack(r["b"])
    sizes, flags = unpack(r["d"]).astype(np.int64), unpack(r["e"], "u1")
    n = np.bincount(codes[np.repeat(flags & 1 == 0, sizes)], minlength=len(words))
    part = words // np.uint64((1 << 64) // homes + 1 if homes > 1 else (1 << 64) - 1)
    part = np.minimum(part, np.uint64(homes - 1)).astype(np.int64)
    bounds = np.searchsorted(part, np.arange(homes + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        at = slice(bounds[k], bounds[k + 1])
        yield {"home": k, "kind": "word", "peer": r["home"], "a": pack_sorted(words[at]), "b": pack(n[at])}


def _vocabulary(part: int, rows: dict) -> Iterator[dict]:
    """The part's words in order of their digests (vocab: peer how many, b counts), and to each slice the places of its own (place: a)."""
    own = [unpack_sorted(r["a"]) for r in rows["word"]]
    union = np.concatenate(own)
    union.sort()
    union = union[_runs(union)]
    n = np.zeros(len(union), np.int64)
    for r, words in zip(rows["word"], own, strict=True):
        at = np.searchsorted(union, words)
        n[at] += unpack(r["b"])
        yield {"home": r["peer"], "kind": "place", "peer": part, "a": pack_sorted(at)}
    yield {"home": part, "kind": "vocab", "peer": len(union), "x": int(n.sum()), "y": int((n > 0).sum()), "b": pack(n, "u8")}


def _frequent(vocabulary: DataFrame, starts: np.ndarray, least: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with at least so many occurrences, of which there are at most HOT for each shard, and the shards of each."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = unpack(r["b"], "u8").astype(np.int64)
                often = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([pa.array(often + starts[r["home"]]), pa.array(n[often])], ["word", "n"])

    found = vocabulary.select("home", "b").mapInArrow(run, "word long, n long").toArrow()
    words, n = found.column("word").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], np.minimum(-(-n[order] // least), shards)


def numbered(parts: DataFrame) -> Corpus:
    """The corpus of a settled table of slices: words are numbered in order of their digests, so codes stay as they are."""
    size = parts.agg(F.coalesce(F.sum("x"), F.lit(0))).first()[0]
    homes = max(1, -(-size // SHARD_TOKENS))
    vocabulary = base.settle(_grouped([_of_slices(parts, lambda r: _words(r, homes))], homes, _vocabulary), "vocabulary")
    counts = vocabulary.where("kind = 'vocab'")
    sizes, total, distinct = np.zeros(homes + 1, np.int64), 0, 0
    for r in counts.select("home", "peer", "x", "y").collect():  # one row a part
        sizes[r.home + 1], total, distinct = r.peer, total + r.x, distinct + r.y
    layout = Layout(homes, np.cumsum(sizes))
    layout.hot, layout.spread = _frequent(counts, layout.starts, max(2, SHARD_TOKENS // HOT), homes)

    def run(home: int, rows: dict) -> Iterator[dict]:
        (own,) = rows["slice"]
        own = own | {"a": pack_sorted(np.concatenate([unpack_sorted(r["a"]) + np.uint64(layout.starts[r["peer"]]) for r in rows["place"]]))}
        yield own
        yield from _asks(own, layout)

    codes = parts.withColumn("a", F.lit(None).cast("binary"))
    coded = base.settle(_grouped([codes, vocabulary.where("kind = 'place'")], homes, run), "coded")
    return Corpus(layout, vocabulary, coded.where("kind = 'slice'"), coded.where("kind = 'ask'"), total, distinct)


def _dishes(layout: Layout):
    def run(shard: int, rows: dict) -> Iterator[dict]:
        """The shard's pairs that occur twice or more (dish: a words, b pairs, c counts, d single pairs of each word as context), what it
        wants to know of their words (want: a), the single pairs of each word (alone: a words, b how many), and those of frequent contexts (hot)."""
        pairs, n, _ = _merged(rows["ask"])
        u, w = np.divmod(pairs, layout.words)
        contexts, single = np.unique(u[n == 1], return_counts=True)
        for k in np.flatnonzero(np.isin(contexts, layout.hot)).tolist():
            yield {"home": shard, "kind": "hot", "peer": int(contexts[k]), "x": int(single[k])}
        words, alone = np.unique(w[n == 1], return_counts=True)
        for k, at in layout.by_part(words):
            yield {"home": k, "kind": "alone", "peer": shard, "a": pack_sorted(words[at]), "b": pack(alone[at])}
        u, w, n = u[n > 1], w[n > 1], n[n > 1]
        if len(n):
            used, place = np.unique(np.concatenate([u, w]), return_inverse=True)
            of = np.zeros(len(used), np.int64)
            both, at, of_single = np.intersect1d(used, contexts, assume_unique=True, return_indices=True)
            of[at] = single[of_single]
            yield {"home": shard, "kind": "dish", "a": pack_sorted(used), "b": pack_sorted(place[: len(n)] * len(used) + place[len(n) :]), "c": pack(n, "u8"), "d": pack(of)}
            for k, at in layout.by_part(used):
                yield {"home": k, "kind": "want", "peer": shard, "a": pack_sorted(used[at])}

    return run


def _first_chances(layout: Layout):
    """The part with its single pairs (vocab: c), and to each shard its words' counts (chance: a)."""

    def run(part: int, rows: dict) -> Iterator[dict]:
        (vocab,), start = rows["vocab"], np.uint64(layout.starts[part])
        n = unpack(vocab["b"], "u8")
        alone = np.zeros(len(n), np.int64)
        for r in rows.get("alone", []):
            alone[unpack_sorted(r["a"]) - start] += unpack(r["b"])
        yield {k: vocab[k] for k in _FIELDS} | {"c": pack(alone, "u8")}
        for r in rows.get("want", []):
            yield {"home": r["peer"], "kind": "chance", "peer": part, "a": pack(n[unpack_sorted(r["a"]) - start], "f4")}

    return run


def _shard_sweep(layout: Layout, number: int, opened_elsewhere: dict[int, int], tables: float, customers: float, floor: float):
    """Seats of a shard after a sweep (seats: a tables of each dish, b their customers), its tables of each word to the parts
    (sent: a), and tables of frequent contexts (hot: x)."""

    def run(shard: int, rows: dict) -> Iterator[dict]:
        if "dish" not in rows:
            return
        (dish,) = rows["dish"]
        words, n, alone = unpack_sorted(dish["a"]).view(np.int64), unpack(dish["c"], "u8").astype(np.int64), unpack(dish["d"]).astype(np.int64)
        u, w = np.divmod(unpack_sorted(dish["b"]).view(np.int64), len(words))
        gain = np.concatenate([unpack(r["a"], "f4") for r in rows["chance"]]).astype(float)  # parts have ranges of words
        p = (gain + (STRENGTH + DISCOUNT * tables) * floor) / (STRENGTH + customers)
        order = np.argsort(-n, kind="stable")
        of = size = None
        opened = alone.copy()
        if "seats" in rows:
            t, sizes = (unpack(rows["seats"][0][k]) for k in "ab")
            place = np.empty(len(n), np.int64)
            place[order] = np.arange(len(n))
            of, size = _regrouped(np.repeat(np.arange(len(n)), t), sizes.astype(np.int64), place)
            opened += np.bincount(u, t, len(words)).astype(np.int64)
        for k, x in opened_elsewhere.items():
            at = np.searchsorted(words, k)
            if at < len(words) and words[at] == k:
                opened[at] = max(x, opened[at])
        of, size = sweep(n[order], of, size, p[w[order]], u[order], opened, np.random.default_rng([20240229, number, shard]))
        of, size = _regrouped(of, size, order)
        t = np.bincount(of, minlength=len(n))
        yield {"home": shard, "kind": "seats", "a": pack(t), "b": pack(size)}
        sent = np.bincount(w, t, len(words)).astype(np.int64)
        for k, at in layout.by_part(words):
            yield {"home": k, "kind": "sent", "peer": shard, "a": pack(sent[at])}
        own = np.bincount(u, t, len(words)).astype(np.int64)
        for k in np.flatnonzero(np.isin(words, layout.hot)).tolist():
            yield {"home": shard, "kind": "hot", "peer": int(words[k]), "x": int(own[k])}

    return run


def _part_sweep(layout: Layout, number: int, tables: float, floor: float):
    """The parent's seats of a part's words (parent: a tables, b their customers, c customers less discounts; x tables, y customers), and
    the latter to each shard that wants them (chance: a)."""

    def run(part: int, rows: dict) -> Iterator[dict]:
        (vocab,), start = rows["vocab"], np.uint64(layout.starts[part])
        c = unpack(vocab["c"], "u8").astype(np.int64)
        wants = {r["peer"]: unpack_sorted(r["a"]) - start for r in rows.get("want", [])}
        for r in rows.get("sent", []):
            c[wants[r["peer"]]] += unpack(r["a"])
        order = np.argsort(-c, kind="stable")
        place = np.empty(len(c), np.int64)
        place[order] = np.arange(len(c))
        n, chance, context = c[order], np.full(len(c), floor), np.zeros(len(c), np.int64)
        random = np.random.default_rng([20240229, 1000 + number, part])
        of, size, opened = None, None, np.zeros(1, np.int64)
        if "parent" in rows:
            t, sizes = unpack(rows["parent"][0]["a"]), unpack(rows["parent"][0]["b"]).astype(np.int64)
            of, size = _regrouped(np.repeat(np.arange(len(c)), t), sizes, place)
            before = np.bincount(of, size, len(c)).astype(np.int64)
            opened[0] = max(int(tables), len(of))
            of, size = step(of, size, before, np.maximum(before - n, 0), np.maximum(n - before, 0), chance, context, opened, random)
        of, size = _regrouped(*sweep(n, of, size, chance, context, opened, random), order)
        t = np.bincount(of, minlength=len(c))
        gain = c - DISCOUNT * t
        yield {"home": part, "kind": "parent", "peer": number, "x": len(of), "y": int(c.sum()), "a": pack(t), "b": pack(size), "c": pack(gain, "f4")}
        for shard, at in wants.items():
            yield {"home": shard, "kind": "chance", "peer": part, "a": pack(gain[at], "f4")}

    return run


def train(corpus: Corpus) -> Model:
    """The model of the texts of a corpus that are not held out. An empty corpus gives the uniform model."""
    layout, homes, floor = corpus.layout, corpus.layout.shards, 1 / (corpus.distinct + 1)
    counted = base.settle(_grouped([corpus.asks], homes, _dishes(layout)), "dishes")
    dishes, wants = counted.where("kind = 'dish'"), counted.where("kind = 'want'")
    base.release(counted)
    first = base.settle(_grouped([corpus.vocabulary.where("kind = 'vocab'"), wants, counted.where("kind = 'alone'")], homes, _first_chances(layout)), "chances")
    vocab = first.where("kind = 'vocab'")

    def opened(*frames: DataFrame) -> np.ndarray:
        out = np.zeros(len(layout.hot), np.int64)
        for f in frames if len(out) else ():
            for r in f.where("kind = 'hot'").groupBy("peer").agg(F.sum("x").alias("x")).collect():
                out[np.searchsorted(layout.hot, r.peer)] += r.x
        return out

    model = Model(corpus, [], [], [], vocab, dishes, [], [])
    chances, tables, customers, seats, parent, hot = first, 0.0, float(corpus.total), None, None, opened(counted)
    for number in range(BURN_IN + SAMPLES):
        elsewhere = dict(zip(layout.hot.tolist(), hot.tolist(), strict=True))
        frames = [dishes, chances.where("kind = 'chance'"), *([seats.where("kind = 'seats'")] if seats else [])]
        moved = base.settle(_grouped(frames, homes, _shard_sweep(layout, number, elsewhere, tables, customers, floor)), "seats")
        hot = opened(counted, moved)
        frames = [vocab, wants, moved.where("kind = 'sent'"), *([parent.where("kind = 'parent'")] if parent else [])]
        above = base.settle(_grouped(frames, homes, _part_sweep(layout, number, tables, floor)), "parent")
        if seats is not None and number <= BURN_IN:
            base.drop(seats, parent)
        base.release(counted)
        seats, parent, chances = moved, above, above
        tables, customers = map(float, above.where("kind = 'parent'").agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first())
        if number >= BURN_IN:
            model.tables.append(tables)
            model.customers.append(customers)
            model.hot_tables.append(hot)
            model.seats.append(moved.where("kind = 'seats'").withColumn("peer", F.lit(number - BURN_IN).cast("long")))
            model.parents.append(above.where("kind = 'parent'").withColumn("peer", F.lit(number - BURN_IN).cast("long")))
    return model


def _pair_answers(layout: Layout, hot_tables: list[np.ndarray]):
    """To each slice (pair): a what the tables of its pairs give them, b tables of its contexts in each sample."""

    def run(shard: int, rows: dict) -> Iterator[dict]:
        if "ask" not in rows:
            return
        pairs, n, at = _merged(rows["ask"])
        u = pairs // layout.words
        first = _runs(u)
        contexts, of = u[first], np.cumsum(first) - 1
        gain = np.where(n > 0, n - DISCOUNT, 0.0)
        opened = np.repeat(np.bincount(of[n == 1], minlength=len(contexts))[None], SAMPLES, axis=0)
        if "dish" in rows:
            seats = [unpack(r["a"]) for r in rows["seats"]]
            several = np.flatnonzero(n > 1)  # in the order of the dishes, which are these pairs
            gain[several] = n[several] - DISCOUNT * np.mean(seats, axis=0)
            for k, t in enumerate(seats):
                opened[k] += np.bincount(of[several], t, len(contexts)).astype(np.int64)
        for k in np.flatnonzero(np.isin(contexts, layout.hot)).tolist():
            opened[:, k] = [tables[np.searchsorted(layout.hot, contexts[k])] for tables in hot_tables]
        for r, own in zip(rows["ask"], at, strict=True):
            asked = of[own]
            yield {"home": r["peer"], "kind": "pair", "peer": shard, "a": pack(gain[own], "f4"), "b": pack(opened[:, asked[_runs(asked)]].ravel())}

    return run


def _word_answers(layout: Layout):
    """To each slice (known): a counts of its words, b what the parent's tables give them in each sample."""

    def run(part: int, rows: dict) -> Iterator[dict]:
        n = unpack(rows["vocab"][0]["b"], "u8")
        gains = [unpack(r["c"], "f4") for r in rows["parent"]]
        for r in rows.get("word", []):
            at = unpack_sorted(r["a"])
            yield {"home": r["peer"], "kind": "known", "peer": part, "a": pack(n[at], "u8"), "b": pack(np.concatenate([g[at] for g in gains]), "f4")}

    return run


def score(model: Model, full: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text of the model's corpus, held out or not, and
    with ``full`` the log10 chance of each token. A null text is empty and has only its end; rows with equal or null doc_id stay rows of their own."""
    corpus, layout, homes = model.corpus, model.corpus.layout, model.corpus.layout.shards
    words = corpus.vocabulary.where("kind = 'place'").select(F.col("peer").alias("home"), F.lit("word").alias("kind"), F.col("home").alias("peer"), *_FIELDS[3:])
    known = base.settle(_grouped([words, model.vocabulary, *model.parents], homes, _word_answers(layout)), "known")
    answers = base.settle(_grouped([corpus.asks, model.dishes, *model.seats], homes, _pair_answers(layout, model.hot_tables)), "answers")
    total, distinct, tables, customers, floor = corpus.total, corpus.distinct, np.array(model.tables), np.array(model.customers), model.floor
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity", *(["chances"] if full else [])]

    def scored(group):
        rows = sorted(group.to_pylist(), key=lambda r: (r["kind"], r["peer"] or 0))
        (own,) = (r for r in rows if r["kind"] == "slice")
        words, token = _tokens(own)
        by_pair = np.argsort(token)
        token = token[by_pair]
        first = _runs(token)
        at_pair = np.empty(len(token), np.int64)
        at_pair[by_pair] = np.cumsum(first) - 1
        u, w = np.divmod(token[first], len(words))
        n, back = np.zeros(len(words), np.int64), np.zeros((SAMPLES, len(words)))
        parts, (order, ends) = dict(layout.by_part(words)), layout.by_shard(words[u], words[w])
        gain, opened = np.zeros(len(u)), np.zeros((SAMPLES, len(u)), np.uint32)
        for r in rows:
            if r["kind"] == "known":
                at = parts[r["peer"]]
                n[at], back[:, at] = unpack(r["a"], "u8"), unpack(r["b"], "f4").reshape(SAMPLES, -1)
            if r["kind"] == "pair":
                at = order[ends[r["peer"]] : ends[r["peer"] + 1]]
                gain[at] = unpack(r["a"], "f4")
                opened[:, at] = unpack(r["b"]).reshape(SAMPLES, -1)[:, np.cumsum(_runs(u[at])) - 1]
        del rows
        p = (back + (STRENGTH + DISCOUNT * tables[:, None]) * floor) / (STRENGTH + customers[:, None])
        for k in range(SAMPLES):
            gain += (STRENGTH + DISCOUNT * opened[k]) * p[k, w] / SAMPLES
        chance = np.log10(gain / (STRENGTH + n[u]))
        each = chance[at_pair]
        sizes, flags = unpack(own["d"]).astype(np.int64), unpack(own["e"], "u1")
        starts = np.cumsum(sizes) - sizes
        codes, base_chance = unpack(own["b"]), np.log10((n + 1) / (total + distinct + 1))
        whole = np.add.reduceat(each, starts)
        out = [pa.array(unpack(own["c"], "i8"), mask=flags & 2 > 0), pa.array(flags & 1 > 0), pa.array(sizes), pa.array(np.add.reduceat((n > 0)[codes], starts, dtype=np.int64)), pa.array(np.full(len(sizes), total))]
        out += [pa.array(np.add.reduceat(base_chance[codes], starts)), pa.array(whole), pa.array(10 ** np.minimum(-whole / sizes, 300))]
        return pa.table(out + ([pa.ListArray.from_arrays(pa.array(np.append(starts, len(each)), pa.int32()), pa.array(each))] if full else []), names=names)

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double" + ", chances array<double>" * full
    return corpus.slices.unionByName(known).unionByName(answers).repartition(2 * homes, "home").groupBy("home").applyInArrow(scored, kinds)


def evaluate(docs: DataFrame, held_out: Column | None = None, full: bool = False) -> DataFrame:
    """Scores of all docs by a model of those that are not held out (a condition on doc_id or text; none: all are learned from).
    Other columns are not read. An empty table gives no rows."""
    parts = base.settle(slices_of(docs, F.lit(False) if held_out is None else held_out), "slices")
    corpus = numbered(parts)
    base.drop(parts)
    model = train(corpus)
    scores = score(model, full)
    model.drop()
    return scores

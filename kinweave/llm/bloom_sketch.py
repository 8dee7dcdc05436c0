"""Document fingerprints by invertible Bloom lookup sketches, in SQL functions alone.

A text is cut into paragraphs: at line feeds and ends of sentences, and within those after
words that end in a fixed letter, so that an edit moves few cuts. Each distinct paragraph
is a 64-bit digest in three of 16 cells; a cell holds a count and the exclusive or of its
digests, whose upper bits check the lower ones. These cells are a text's fingerprint. Two fingerprints subtract cell by
cell: shared digests cancel, and peeling recovers the others out of cells with one digest left. Where it stalls, larger
sketches of both texts are tried: their digests are dealt into many such tables by a hash, and those of a table that stalls
into eight more, until all are recovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import base

#: Cells of a table; digests of two texts in a table of a larger sketch, on average, at most; tables that a stalled one is dealt into;
#: rounds of peeling a table.
CELLS, LOAD, FANOUT, ROUNDS = 16, 5, 8, 8
#: Documents in a range of ids, about, and the quantiles of ids between which ranges are of equal width.
RANGE_DOCS, QUANTILES = 2000, 64
#: Fixed rule: a paragraph ends after a line feed, a mark that ends a sentence in one of several scripts, or a word that ends in this letter.
CUT = r"(?<=[\n.!?|。！？؟।])|(?<=[y] )"


def _sealed(low: Column) -> Column:
    """44 bits with a 20-bit check of them on top."""
    return F.shiftleft(F.xxhash64(low, F.lit("check")), 44).bitwiseOR(low)


def paragraphs(text: Column) -> Column:
    """Digests of the distinct paragraphs of a text; an empty text has none."""
    parts = F.array_distinct(F.filter(F.split(text, CUT), lambda p: F.trim(p) != ""))
    lows = F.transform(parts, lambda p: F.xxhash64(p).bitwiseAND(F.lit((1 << 44) - 1)))
    return F.transform(lows, _sealed)


def _position(digest: Column, k: int) -> Column:
    """Cell k of a digest: the three lie in disjoint parts of the table, of 5, 5 and 6 cells."""
    return F.pmod(F.shiftrightunsigned(digest, 14 * k).bitwiseAND(F.lit(0x3FFF)), F.lit((5, 5, 6)[k])).cast("int") + 5 * k


def tabled(digests: DataFrame, *by: str) -> DataFrame:
    """by, n and k: a table of each group's digests, those of sign -1 taken away. A null digest leaves its group's table empty."""
    at = [_position(F.col("digest"), k) for k in range(3)]
    cells = []
    for j in range(CELLS):
        here = at[0 if j < 5 else 1 if j < 10 else 2] == j
        cells += [F.coalesce(F.sum(F.when(here, F.col("sign"))), F.lit(0)).cast("int").alias(f"n{j}"), F.coalesce(F.bit_xor(F.when(here, F.col("digest"))), F.lit(0)).alias(f"k{j}")]
    arrays = (F.array(*(F.col(f"{x}{j}") for j in range(CELLS))).alias(x) for x in "nk")
    return digests.groupBy(*by).agg(*cells).select(*by, *arrays)


def printed(n: Column, k: Column) -> Column:
    """A table as text."""
    part = F.zip_with(n, k, lambda x, y: F.concat(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.lpad(F.hex(y), 16, "0")))
    return F.lower(F.array_join(part, ""))


def parsed(text: Column) -> tuple[Column, Column]:
    """The cells of a printed table."""
    places = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def number(start: int, digits: int) -> Column:
        # conv gives unsigned text; signs come back by the two's complement of the upper half.
        half = lambda i, a: F.conv(F.substring(text, i * 24 + a, F.lit(8)), 16, 10).cast("long")
        if digits == 8:
            return F.transform(places, lambda i: F.shiftright(F.shiftleft(half(i, start), 32), 32).cast("int"))
        return F.transform(places, lambda i: F.shiftleft(half(i, start), 32).bitwiseOR(half(i, start + 8)))

    return number(1, 8), number(9, 16)


_STATE = "struct<cells:array<struct<n:int,k:bigint>>,out:array<struct<n:int,k:bigint,at:int>>,ended:boolean>"


def peeled(tables: DataFrame) -> DataFrame:
    """tables (with n and k, differences of two) and only_a, only_b: the digests recovered from them; null if cells remain.

    A round takes the digests of all cells that have a single one out of their three cells each (bits of ``at``). A table that
    ROUNDS do not clear counts as stalled.
    """
    start = "named_struct('cells', arrays_zip(n, k), 'out', array(), 'ended', false)"
    single = "abs(c.n) = 1 and (shiftleft(xxhash64(c.k & 17592186044415L, 'check'), 44) | (c.k & 17592186044415L)) = c.k"
    at = " | ".join(f"shiftleft({1 << 5 * k}, cast(pmod(shiftrightunsigned(d.k, {14 * k}) & 16383, {(5, 5, 6)[k]}) as int))" for k in range(3))
    digests = f"transform(array_distinct(filter(s.cells, c -> {single})), d -> named_struct('n', d.n, 'k', d.k, 'at', {at}))"
    less = "aggregate(found, c, (x, d) -> if(shiftright(d.at, j) & 1 = 1, named_struct('n', x.n - d.n, 'k', x.k ^ d.k), x))"
    step = f"""(s, i) -> if(s.ended, s, transform(array({digests}), found -> if(size(found) = 0,
            named_struct('cells', s.cells, 'out', s.out, 'ended', true),
            named_struct('cells', transform(s.cells, (c, j) -> {less}), 'out', concat(s.out, found), 'ended', false)))[0])"""
    out = tables.withColumn("s", F.expr(f"aggregate(sequence(1, {ROUNDS}), cast({start} as {_STATE}), {step})"))
    clear = ~F.exists("s.cells", lambda c: (c["n"] != 0) | (c["k"] != 0))
    told = {c: F.when(clear, F.transform(F.filter("s.out", lambda d: d["n"] == sign), lambda d: d["k"])) for c, sign in (("only_a", 1), ("only_b", -1))}
    return out.withColumns(told).drop("s")


def _path(digest: Column, tables: Column, level: int) -> Column:
    """The table of a digest in the sketch that is so many retries larger than the first."""
    path = F.pmod(F.xxhash64(digest, F.lit("deal 0")), tables)
    for k in range(1, level + 1):
        path = F.xxhash64(path, F.pmod(F.xxhash64(digest, F.lit(f"deal {k}")), F.lit(FANOUT)))
    return path


def _subtracted(a: str, b: str) -> list[Column]:
    return [F.zip_with(f"{a}.n", f"{b}.n", lambda x, y: x - y).alias("n"), F.zip_with(f"{a}.k", f"{b}.k", lambda x, y: x.bitwiseXOR(y)).alias("k")]


def compared(pairs: DataFrame) -> DataFrame:
    """pairs (with the printed fingerprints a and b) and only_a, only_b: the digests that one text has and not the other, found
    from these alone; null if they differ in too many for that."""
    cells = {c: F.struct(*(x.alias(y) for x, y in zip(parsed(F.col(c)), "nk", strict=True))) for c in ("a", "b")}
    held = pairs.select(*pairs.columns, *(x.alias(f"cells_{c}") for c, x in cells.items()))
    return peeled(held.select(*pairs.columns, *_subtracted("cells_a", "cells_b"))).drop("n", "k")


def recovered(rows: DataFrame, prints: DataFrame, full: bool = False) -> DataFrame:
    """row, pair, n_a, n_b: how many digests only one of two texts has, by peeling; with ``full`` also only_a and only_b, these
    digests, of pair 0.

    rows (settled): row and the digests own, edit, next of three texts; pair 0 is own and edit, 1 is own and next. prints: row
    and the cells of each text. The fingerprints are tried first, then larger sketches of those that stall, as often as needed:
    distinct digests part sooner or later.
    """
    side = {0: "edit", 1: "next"}

    def told(tables: DataFrame) -> DataFrame:
        # Digests are returned of a text and its edit: those of the next document are counted where they are recovered.
        arrays = [F.when(F.col("pair") == 0, F.col(c)).alias(c) for c in ("only_a", "only_b")] if full else []
        return peeled(tables).select(*(c for c in tables.columns if c not in ("n", "k")), *(F.when(F.col(c).isNotNull(), F.size(c)).alias(f"n_{c[-1]}") for c in ("only_a", "only_b")), *arrays)

    names = ["row", "pair", "n_a", "n_b", *(["only_a", "only_b"] if full else [])]
    both = F.explode(F.array(*(F.struct(F.lit(p).alias("pair"), *_subtracted("own", x)) for p, x in side.items()))).alias("x")
    level = base.settle(told(prints.select("row", both).select("row", "x.*")), "level")
    found = [level.where("n_a is not null").select(names)]
    stalled = level.where("n_a is null").groupBy("row").agg(*(F.max(F.when(F.col("pair") == p, F.array().cast("array<bigint>"))).alias(f"path{p}") for p in side))
    step = 0
    while not stalled.isEmpty():
        held = rows.join(stalled, "row")

        def dealt(p: int, name: str, sign: int) -> Column:
            tables = F.greatest(F.lit(1), F.ceil((F.size("own") + F.size(side[p])) / LOAD)).cast("long")
            own = F.col(f"path{p}")
            kept = F.filter(name, lambda d: F.array_contains(own, _path(d, tables, step - 1))) if step else F.col(name)
            return F.transform(F.when(own.isNotNull(), kept).otherwise(F.array().cast("array<bigint>")), lambda d: F.struct(F.lit(p).alias("pair"), d.alias("digest"), F.lit(sign).alias("sign"), _path(d, tables, step).alias("path")))

        digests = held.select("row", F.explode(F.concat(*(dealt(p, x, sign) for p in side for x, sign in (("own", 1), (side[p], -1))))).alias("x")).select("row", "x.*")
        level = base.settle(told(tabled(digests, "row", "pair", "path")), "level")
        base.release(level)
        found.append(level.where("n_a is not null").select(names))
        stalled = level.where("n_a is null").groupBy("row").agg(*(F.collect_list(F.when(F.col("pair") == p, F.col("path"))).alias(f"path{p}") for p in side))
        step += 1
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text and (area, place), which name a row: the next document descends by doc_id (equal ids by text,
    null ids last), and the first follows the last.

    Ids are cut into areas at quantiles, and between two of these into equal widths, so ids far apart or crowded don't meet
    in one task. Rows of one id do.
    """
    docs = base.only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    places = [k / QUANTILES for k in range(QUANTILES + 1)]
    bounds, n = docs.agg(F.percentile_approx("doc_id", places, 10 * QUANTILES), F.count("*")).first()
    bounds = sorted(set(bounds or [0]))
    each = max(1, -(-n // (RANGE_DOCS * QUANTILES)))  # areas between two quantiles
    # Where an id lies between its two bounds, in whole widths; decimals hold the distance of any two ids.
    spans = [(low, (high - low) // each + 1) for low, high in zip(bounds, bounds[1:] + [bounds[-1]], strict=True)]

    def area(first: int, last: int) -> Column:
        if last - first == 1:
            low, width = spans[first]
            return F.lit(first * (each + 1)) + F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)"))
        mid = (first + last) // 2
        return F.when(F.col("doc_id") < F.lit(bounds[mid]), area(first, mid)).otherwise(area(mid, last))

    number = F.greatest(F.coalesce(area(0, len(spans)), F.lit(-1)), F.lit(-1)).cast("long")
    number = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.greatest(number, F.lit(0))).cast("long")
    docs = docs.withColumn("area", number)
    within = W.partitionBy("area").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = docs.withColumn("place", F.row_number().over(within)).withColumn("next_text", F.lead("text").over(within))
    # An area's last row is followed by the first of the next area below; one row an area.
    areas = docs.select("area").distinct()
    below = areas.select("area", F.coalesce(F.lead("area").over(W.orderBy(F.desc("area"))), F.max("area").over(W.partitionBy())).alias("below"))
    firsts = rows.where("place = 1").select(F.col("area").alias("below"), F.col("text").alias("first_text"))
    return rows.join(below.join(firsts, "below").select("area", "first_text"), "area").withColumn("next_text", F.coalesce("next_text", "first_text")).drop("first_text")


def fingerprints(docs: DataFrame, full: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text and of its
    edit: the last half of its characters replaced by the first as many of the next document. With ``full`` also the
    digests that only the text or only its edit has (only_text, only_edited).

    Likeness is shared digests by all digests of both; two texts without paragraphs are alike (1). A null text is empty. Rows
    with equal or null doc_id stay rows of their own; an empty table gives no rows; other columns are not read.
    """
    n = F.char_length("text")
    rows = with_next(docs).withColumn("n_chars", n.cast("long"))
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("edit"), paragraphs(F.col("next_text")).alias("next"))
    rows = base.settle(rows, "digests")
    base.release(rows)
    names = ["own", "edit", "next"]

    # A null digest stands in for each text, so that one without paragraphs has a table too.
    def of(k: int, name: str) -> Column:
        return F.transform(F.concat(name, F.array(F.lit(None).cast("bigint"))), lambda d: F.struct(F.lit(k).alias("side"), d.alias("digest"), F.lit(1).alias("sign")))

    each = F.explode(F.concat(*(of(k, x) for k, x in enumerate(names)))).alias("x")
    cells = tabled(rows.select("row", each).select("row", "x.*"), "row", "side")
    prints = base.settle(cells.groupBy("row").agg(*(F.max(F.when(F.col("side") == k, F.struct("n", "k"))).alias(x) for k, x in enumerate(names))), "prints")
    base.release(prints)
    found = recovered(rows, prints, full).groupBy("row").agg(*(F.sum(F.when(F.col("pair") == p, F.col(c)).otherwise(0)).alias(f"{c}{p}") for p in (0, 1) for c in ("n_a", "n_b")), *([F.flatten(F.collect_list(F.when(F.col("pair") == 0, F.col(c)))).alias(x) for c, x in (("only_a", "only_text"), ("only_b", "only_edited"))] if full else []))
    sizes = rows.select("row", "doc_id", "n_chars", "edited_sha256", F.size("own").cast("long").alias("n_own"))
    texts = prints.select("row", printed(F.col("own.n"), F.col("own.k")).alias("fingerprint"), printed(F.col("edit.n"), F.col("edit.k")).alias("edited_fingerprint"))

    def likeness(p: int) -> Column:
        union = F.col("n_own") + F.col(f"n_b{p}")
        return F.when(union == 0, F.lit(1.0)).otherwise((F.col("n_own") - F.col(f"n_a{p}")) / union)

    whole = sizes.join(texts, "row").join(found, "row")
    return whole.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(0).alias("near_edited"), likeness(1).alias("near_next"), *(["only_text", "only_edited"] if full else []))

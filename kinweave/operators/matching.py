"""Need and offer matching: terms of one side against texts of the other, with evidence and without a score.

Single: the terms of one contact or query are few (24 a text side), so they are literals of a plan that scans the
corpus once a pool. Batch: terms of a stated set of sources meet the postings of the corpus in equi-joins: prefixes are
expanded over the vocabulary alone, never over all tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import drop, settle, spread
from . import contacts as C
from . import search as S
from .postings import scored

#: Terms taken from a text, rows of a pool, evidence kept for a candidate, candidates returned at most.
MAX_TERMS, POOL, MAX_EVIDENCE, MAX_RESULTS = 24, 200, 12, 10
#: Hits of a task that sums ranks, where each takes part for every set of terms that has its term; texts of a task that counts them.
HITS, ROWS = 100_000, 5_000
#: Letters from which a term may stand for a prefix.
PREFIX_LENGTH = 3

# Words that say nothing about a need or an offer, German and English.
STOP_WORDS = frozenset(
    S.fold(w)
    for w in """
    und oder aber denn doch nicht auch noch schon sehr mehr alle alles etwas jemand gerne gern immer viel viele
    der die das den dem des ein eine einen einem einer eines ich mir mich wir uns ihr sie man wer was wie wo wann
    ist sind war waren hat habe haben kann können will wollen möchte suche suchen sucht biete bieten bietet brauche brauchen
    braucht für mit von vom zum zur auf aus bei nach über unter dass weil wenn sich jemanden thema gerade aktuell
    and the for with from into about that this these those are was were been have has had can could will would
    should need needs needed looking look want wants offer offers offering help helping some any all more most very just
    who what where when why how out than then also not but get got someone anyone currently
    """.split()
)


def prefix_capable(term: str) -> bool:
    return len(term) >= PREFIX_LENGTH and term not in STOP_WORDS


def extract_terms(text: str) -> list[str]:
    """Distinct usable tokens of a text in order, on the driver, for one contact or query."""
    return list(dict.fromkeys(t for t in S.split_tokens(text) if prefix_capable(t)))[:MAX_TERMS]


def terms_of(text: Column) -> Column:
    """The same as an expression: array of the first distinct usable tokens."""
    usable = F.filter(X.tokens(text), lambda t: (F.char_length(t) >= PREFIX_LENGTH) & ~t.isin(*sorted(STOP_WORDS)))
    return F.slice(F.array_distinct(usable), 1, MAX_TERMS)


def text_hits(text: Column, terms: Sequence[str]) -> Column:
    """Terms with which the folded text or one of its tokens begins, in order."""
    if not terms:
        return F.array().cast("array<string>")
    # The text and its tokens are one array, bound once, so that they are not cut anew for each term.
    starts = F.concat(F.array(X.norm_text(text)), X.tokens(text))
    hit = F.transform(F.array(starts), lambda s: F.filter(F.array(*map(F.lit, terms)), lambda t: F.exists(s, lambda w: w.startswith(t))))
    return F.coalesce(F.get(hit, F.lit(0)), F.array().cast("array<string>"))


def tag_hits(tag: Column, terms: Sequence[str]) -> Column:
    """Terms that are the tag, or, if they may stand for a prefix, begin it."""
    name = X.norm_text(tag)
    hit = F.array_compact(F.array(*(F.when((name == t) | (name.startswith(t) if prefix_capable(t) else F.lit(False)), F.lit(t)) for t in terms)))
    return hit if terms else F.array().cast("array<string>")


def _counted(contacts: DataFrame, needs: DataFrame, offers: DataFrame, tagged: DataFrame, for_offers: Sequence[str], for_needs: Sequence[str], profile: Sequence[str]) -> DataFrame:
    """id, name, active, tagged, len and how often each term occurs in the columns of its own side: o0, n0, p0 and so on.

    Items are counted where they lie and summed, never put together; of the two sides of the join, as large as the contacts, none is
    broadcast, however small its files look.
    """
    def counts(terms: Sequence[str], *texts: str) -> Column:
        # How many tokens the texts have, then how many of them begin with each term; the tokens are bound once.
        count = lambda t: F.array(F.size(t), *(S.occurrences(t, [x]) for x in terms)).cast("array<long>")
        return F.get(F.transform(F.array(F.concat(*(X.tokens(F.col(c)) for c in texts))), count), F.lit(0))

    sides = {"o": for_offers, "n": for_needs}
    names = [f"{s}{k}" for s, terms in sides.items() for k in range(len(terms))]
    zero = F.lit(0).cast("long")

    def side(items: DataFrame, own: str) -> DataFrame:
        rows = items.select(F.col("contact_id").alias("id"), counts(sides[own], "text").alias("c"))
        found = {f"{own}{k}": F.get("c", F.lit(k + 1)) for k in range(len(sides[own]))}
        return rows.select("id", F.get("c", F.lit(0)).alias("len"), F.lit(0).alias("tagged"), *(found.get(n, zero).alias(n) for n in names))

    held = tagged.select("id", zero.alias("len"), F.lit(1).alias("tagged"), *(zero.alias(n) for n in names))
    sums = side(offers, "o").unionByName(side(needs, "n")).unionByName(held).groupBy("id").agg(F.sum("len").alias("items_len"), F.max("tagged").alias("tagged"), *(F.sum(n).alias(n) for n in names))
    rows = contacts.select("id", "name", (F.col("status") == "active").alias("active"), X.tokens(F.col("name")).alias("t"), counts(profile, "company", "title", "how_we_met").alias("c"))
    rows = rows.select("id", "name", "active", (F.size("t") + F.get("c", F.lit(0))).alias("own_len"), *(F.get("c", F.lit(k + 1)).alias(f"p{k}") for k in range(len(profile))))
    rows = rows.join(sums.hint("merge"), "id", "left").fillna(0, ["items_len", "tagged", *names])
    return rows.select("id", "name", "active", (F.col("tagged") == 1).alias("tagged"), (F.col("own_len") + F.col("items_len")).alias("len"), *names, *(f"p{k}" for k in range(len(profile))))


def find_matches(contacts: DataFrame, needs: DataFrame, offers: DataFrame, contact_tags: DataFrame, tags: DataFrame, *, contact_id: int | None = None, query: str | None = None, limit: int = MAX_RESULTS) -> DataFrame:
    """place, id, name, matched_on array<struct<kind, text, term>> of the best active candidates.

    Raises ValueError without a contact or a query, LookupError for an unknown contact. Candidates come from pools of the
    best 200 active rows a side, and from tags; without evidence among open items, tags or (query only) profile
    texts a candidate is dropped. A tag's holder has evidence and stands behind the pools, so of the holders only as many by name are
    candidates as could still be shown, and only candidates' evidence is looked for.
    """
    query = (query or "").strip()
    if contact_id is None and not query:
        raise ValueError("a contact or a query is needed")
    limit = min(limit, MAX_RESULTS)
    need_terms, offer_terms, own_tags, query_terms = [], [], [], extract_terms(query[:500])
    if contact_id is not None:
        if contacts.where(F.col("id") == contact_id).isEmpty():
            raise LookupError(f"no contact {contact_id}")
        mine = F.col("contact_id") == contact_id
        firsts = _first_terms(needs.where(mine), 0).unionByName(_first_terms(offers.where(mine), 1)).orderBy("side", "ord").collect()  # 24 a side
        need_terms, offer_terms = ([r.term for r in firsts if r.side == side] for side in (0, 1))
        own_tags = [r.name for r in contact_tags.where(mine).join(tags.withColumnRenamed("id", "tag_id"), "tag_id").select("name").orderBy("name").collect()]
    for_offers, for_needs = list(dict.fromkeys(need_terms + query_terms)), list(dict.fromkeys(offer_terms + query_terms))
    tag_terms = list(dict.fromkeys([*map(S.fold, own_tags), *query_terms]))
    hit_tags = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"), tag_hits(F.col("name"), tag_terms).alias("hits")).where(F.size("hits") > 0)
    tag_rows = contact_tags.withColumnRenamed("contact_id", "id").join(hit_tags, "tag_id")
    counted = settle(_counted(contacts, needs, offers, tag_rows, for_offers, for_needs, query_terms), "frequencies")
    other = F.col("id") != contact_id if contact_id is not None else F.lit(True)
    folded = X.norm_text(F.col("name"))
    # Of the first holders by name at most three pools and the contact itself are not behind the pools.
    behind = counted.where("active and tagged").orderBy(folded, "id").limit(limit + 3 * POOL + 1)
    found = behind.select("id", "name", F.lit(float("inf")).alias("rank"))
    for terms, own in ((for_offers, "o"), (for_needs, "n"), (query_terms, "p")):
        if terms:
            row = counted.select(F.struct("id", "name", "active").alias("at"), "len", *(F.col(f"{own}{k}").alias(f"f{k}") for k in range(len(terms))))
            ranks = scored(row, len(terms), True, "at").where("at.active").select("at.id", "at.name", F.round("rank", 9).alias("rank"))
            found = found.unionByName(ranks.orderBy("rank", "id").limit(POOL))
    best = settle(found.where(other).groupBy("id", "name").agg(F.min("rank").alias("rank")), "best")
    candidates = F.broadcast(best.select("id"))  # three pools and the holders behind them at most

    def evidence(rows: DataFrame, side: int, kind: str, text: str, order: Column, hits: Column) -> DataFrame:
        return rows.join(candidates, "id", "left_semi").select(F.col("id"), F.lit(side).alias("side"), order.cast("string").alias("ord"), F.posexplode(hits).alias("at", "term"), F.lit(kind).alias("kind"), F.col(text).alias("text"))

    def items(df: DataFrame) -> DataFrame:
        return C.open_items(df).select(F.col("contact_id").alias("id"), F.concat_ws("|", "created_at", F.lpad(F.col("id").cast("string"), 20, "0")).alias("o"), "text")

    proof = evidence(items(offers), 0, "offer", "text", F.col("o"), text_hits(F.col("text"), for_offers))
    proof = proof.unionByName(evidence(items(needs), 1, "need", "text", F.col("o"), text_hits(F.col("text"), for_needs)))
    proof = proof.unionByName(evidence(tag_rows, 2, "tag", "tag", X.nocase(F.col("tag")), F.col("hits")))
    for k, c in enumerate(("company", "title", "how_we_met")):
        if query_terms:
            proof = proof.unionByName(evidence(contacts, 3 + k, "profile", c, F.lit(""), text_hits(F.col(c), query_terms)))
    # The best that have any evidence come first; only what these few have is put in order and gathered.
    proof = settle(proof, "proof")
    proven = best.join(proof.select("id").distinct(), "id", "left_semi")
    top = settle(proven.orderBy("rank", folded, "id").limit(limit), "top")
    order = W.partitionBy("id").orderBy("side", "ord", "at")
    kept = proof.join(F.broadcast(top.select("id")), "id", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= MAX_EVIDENCE)
    listed = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "kind", "text", "term"))), lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["term"].alias("term"))).alias("matched_on"))
    return top.join(listed, "id").withColumn("place", F.row_number().over(W.orderBy("rank", folded, "id"))).select("place", "id", "name", "matched_on")


def _first_terms(items: DataFrame, side: int) -> DataFrame:
    """source_id, side, term, ord: the first usable terms of each contact's open items, in their order. side: where candidates must
    have them. No contact's items are put together: each term's first place is a minimum."""
    words = C.open_items(items).select(F.col("contact_id").alias("source_id"), F.struct("created_at", "id").alias("item"), F.posexplode(X.tokens(F.col("text"))).alias("pos", "term"))
    usable = words.where((F.char_length("term") >= PREFIX_LENGTH) & ~F.col("term").isin(*sorted(STOP_WORDS)))
    first = usable.groupBy("source_id", "term").agg(F.min(F.struct("item.created_at", "item.id", "pos")).alias("at"))
    ord_ = F.row_number().over(W.partitionBy("source_id").orderBy("at"))
    return first.withColumn("ord", ord_).where(F.col("ord") <= MAX_TERMS).select("source_id", F.lit(side).alias("side"), "term", "ord")


def _reached(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(side, token, term) for the distinct tokens of words (side, token) and the asked terms (side, term) that begin them."""
    begins = F.transform(F.sequence(F.lit(PREFIX_LENGTH), F.char_length("token")), lambda n: F.substring(F.col("token"), F.lit(1), n))
    vocabulary = words.select("side", "token").where(F.char_length("token") >= PREFIX_LENGTH).distinct()
    return vocabulary.select("side", "token", F.explode(begins).alias("term")).join(asked, ["side", "term"], "left_semi")


#: Holders of a tag that can be among a source's results: behind all of both pools, the results before them and the source itself.
_HOLDERS = 2 * POOL + MAX_RESULTS + 1


def match_all(contacts: DataFrame, needs: DataFrame, offers: DataFrame, contact_tags: DataFrame, tags: DataFrame, sources: DataFrame | None = None, limit: int = MAX_RESULTS) -> DataFrame:
    """source_id, place, id, name, matched_on: what ``find_matches`` gives for each contact (or each id of sources), in one plan.

    Terms of open needs meet the candidates' offers and the other way round; own tags meet tags. Sources with the same set of terms
    share a pool, so its ranks are summed once; sources with the same sets and tags share a profile, whose best candidates and their
    evidence are found once, with one more than are asked for, as the source itself may be among them. A term's hits in a candidate are
    kept up to its first twelve items, more than which no evidence can name; of a tag's holders as many as could still be among the
    results behind both pools. So neither a contact with very many items nor a tag that a third of all contacts have is gathered in one task.
    """
    limit = min(limit, MAX_RESULTS)
    ids = contacts.select(F.col("id").alias("source_id")) if sources is None else sources.select(F.col("id").alias("source_id")).distinct()
    active = contacts.where("status = 'active'").select("id", "name", X.norm_text(F.col("name")).alias("folded"))
    terms = _first_terms(needs, 0).unionByName(_first_terms(offers, 1)).join(ids, "source_id", "left_semi")
    by_order, by_set = F.array_sort(F.collect_list(F.struct("ord", "term"))), F.array_sort(F.collect_list("term"))  # 24 at most
    lists = terms.groupBy("source_id", "side").agg(F.transform(by_order, lambda x: x["term"]).alias("list"), by_set.alias("set"))
    lists = lists.select("source_id", "side", F.array_join("list", " ").alias("list"), F.array_join("set", " ").alias("set"))
    own = contact_tags.select("contact_id", "tag_id").distinct()
    tagged = own.join(ids.withColumnRenamed("source_id", "contact_id"), "contact_id", "left_semi").groupBy(F.col("contact_id").alias("source_id")).agg(F.array_join(F.array_sort(F.collect_list("tag_id")), " ").alias("set"))
    of = lambda side, column: F.coalesce(F.max(F.when(F.col("side") == side, F.col(column))), F.lit(""))
    asks = lists.unionByName(tagged.select("source_id", F.lit(2).alias("side"), F.lit("").alias("list"), "set")).groupBy("source_id")
    asks = settle(asks.agg(of(0, "list").alias("list0"), of(1, "list").alias("list1"), of(0, "set").alias("set0"), of(1, "set").alias("set1"), of(2, "set").alias("tag_set")), "asks")
    profiles = settle(asks.select("set0", "set1", "tag_set").distinct().withColumn("profile", F.monotonically_increasing_id()), "profiles")
    sided = profiles.select("profile", F.inline(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"set{k}").alias("set")) for k in (0, 1))))).where("set <> ''")
    pooled = settle(sided.select("side", "set").distinct().withColumn("pool", F.monotonically_increasing_id()), "pooled")
    sided = sided.join(pooled, ["side", "set"]).select("profile", "pool")
    in_sets = pooled.select("pool", "side", F.explode(F.split("set", " ")).alias("term"))
    asked = in_sets.select("side", "term").distinct()
    # Words of both sides, and each contact's length over all indexed columns.
    both = offers.select(F.lit(0).alias("side"), "*").unionByName(needs.select(F.lit(1).alias("side"), "*"))
    words = settle(both.select("side", "contact_id", "id", "created_at", "resolved_at", F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("side", "contact_id", "id", "created_at", "resolved_at", "token").agg(F.count("*").alias("f")), "words")
    names = contacts.select("id", sum(F.size(X.tokens(F.col(c))) for c in ("name", "company", "title", "how_we_met")).alias("n"))
    sizes = names.unionByName(words.select(F.col("contact_id").alias("id"), F.col("f").alias("n"))).groupBy("id").agg(F.sum("n").alias("len")).join(contacts.select("id"), "id", "left_semi")
    sizes = settle(sizes, "sizes")
    stats = sizes.agg(F.count("*").alias("rows"), F.avg("len").alias("mean"))
    reach = settle(_reached(words, asked), "reach")
    hits = words.join(reach, ["side", "token"]).groupBy("side", "term", F.col("contact_id").alias("id")).agg(F.sum("f").alias("f")).join(contacts.select("id"), "id", "left_semi")
    hits = settle(hits, "hits")
    idf = hits.groupBy("side", "term").agg(F.count("*").alias("n")).join(F.broadcast(stats)).select("side", "term", "mean", F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("raw"))
    idf = settle(idf, "idf")
    # A candidate's hits lie in one task, so its ranks in all pools are summed there.
    weighed = spread(hits, HITS, "id").join(active.select("id"), "id", "left_semi").join(sizes, "id").join(idf, ["side", "term"]).selectExpr("side", "term", "id", "if(raw > 0, raw, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) w")
    scored = weighed.join(in_sets, ["side", "term"]).groupBy("pool", "id").agg(F.round(-F.sum("w"), 9).alias("rank"))
    place = F.row_number().over(W.partitionBy("pool").orderBy("rank", "id"))
    pools = settle(scored.withColumn("n", place).where(F.col("n") <= POOL).select("pool", "id", "rank"), "pools")
    ranked = sided.join(pools, "pool").select("profile", "id", "rank")
    # Tags: a tag's own name as a term, and the tags that it reaches.
    named = tags.select(F.col("id").alias("tag_id"), "name", X.norm_text(F.col("name")).alias("folded"))
    worded = named.where(F.size(X.tokens(F.col("name"))) > 0)
    short = (F.char_length("folded") < PREFIX_LENGTH) | F.col("folded").isin(*sorted(STOP_WORDS))
    begins = F.transform(F.sequence(F.lit(1), F.char_length("folded")), lambda n: F.substring(F.col("folded"), F.lit(1), n))
    reached = worded.select(F.col("tag_id").alias("to_id"), F.col("name").alias("tag"), F.col("folded").alias("whole"), F.explode(begins).alias("folded"))
    meets = named.join(reached, "folded").where((F.col("folded") == F.col("whole")) | ~short).select(F.col("tag_id"), F.col("folded").alias("term"), F.col("name").alias("own"), "to_id", "tag")
    in_tags = profiles.where("tag_set <> ''").select("tag_set").distinct().select("tag_set", F.explode(F.split("tag_set", " ").cast("array<long>")).alias("tag_id"))
    to = settle(in_tags.join(meets, "tag_id").select("tag_set", "to_id", "tag", "term", "own"), "meets")
    held = own.select(F.col("contact_id").alias("id"), F.col("tag_id").alias("to_id"))
    first = F.row_number().over(W.partitionBy("to_id").orderBy("folded", "id"))
    holders = held.join(active, "id").withColumn("n", first).where(F.col("n") <= _HOLDERS).drop("n")
    tagged = to.select("tag_set", "to_id").distinct().join(holders, "to_id").select("tag_set", "id", "folded").distinct()
    tagged = tagged.withColumn("n", F.row_number().over(W.partitionBy("tag_set").orderBy("folded", "id"))).where(F.col("n") <= _HOLDERS)
    by_tag = profiles.join(tagged, "tag_set").select("profile", "id", F.lit(float("inf")).alias("rank"))
    pairs = settle(ranked.unionByName(by_tag).groupBy("profile", "id").agg(F.min("rank").alias("rank")), "pairs")
    # Evidence among the candidates' open items: the first twelve of a term and a candidate are more than any list can name.
    candidates = settle(pairs.select("id").distinct(), "candidates")
    held = settle(held.join(candidates, "id", "left_semi"), "held")
    opened = words.where("resolved_at is null").withColumnRenamed("id", "item").withColumnRenamed("contact_id", "id").join(candidates, "id", "left_semi")
    opened = opened.join(reach, ["side", "token"]).select("side", "term", "id", "created_at", "item").distinct()
    nth = F.row_number().over(W.partitionBy("side", "term", "id").orderBy("created_at", "item"))
    opened = settle(opened.withColumn("n", nth).where(F.col("n") <= MAX_EVIDENCE).drop("n"), "opened")

    def proofs(pairs: DataFrame) -> DataFrame:
        """profile, id, side, o (order within a side), own (tags: what reaches them), term, item or tag, of the pairs (profile, id)."""
        items = pairs.join(sided, "profile").join(in_sets, "pool").join(opened, ["side", "term", "id"])
        items = items.select("profile", "id", "side", F.concat_ws("|", "created_at", F.lpad(F.col("item").cast("string"), 20, "0")).alias("o"), F.lit("").alias("own"), "term", "item", F.lit(None).cast("string").alias("tag"))
        tag = pairs.join(profiles.select("profile", "tag_set"), "profile").join(held, "id").join(to, ["tag_set", "to_id"])
        return items.unionByName(tag.select("profile", "id", F.lit(2).alias("side"), X.nocase(F.col("tag")).alias("o"), "own", "term", F.lit(None).cast("long").alias("item"), "tag"))

    # The best that have any; then these few get their evidence.
    shown = pairs.join(proofs(pairs.select("profile", "id")).select("profile", "id").distinct(), ["profile", "id"], "left_semi").join(active, "id")
    best = F.row_number().over(W.partitionBy("profile").orderBy("rank", "folded", "id"))
    shown = settle(shown.withColumn("n", best).where(F.col("n") <= limit + 1).select("profile", "n", "id", "name"), "shown")
    # The order of an item's terms is the source's own: the first twelve items hold the first twelve entries in any order.
    nth = F.dense_rank().over(W.partitionBy("profile", "id").orderBy("side", "o"))
    kept = settle(proofs(shown.select("profile", "id")).withColumn("n", nth).where(F.col("n") <= MAX_EVIDENCE).drop("n"), "kept")
    texts = both.select("side", F.col("id").alias("item"), F.col("contact_id").alias("id"), "text").join(kept.where("side < 2").select("side", "item", "id").distinct(), ["side", "item", "id"], "left_semi")
    kept = kept.join(settle(texts, "texts"), ["side", "item", "id"], "left")
    kind = F.element_at(F.array(*map(F.lit, ("offer", "need", "tag"))), F.col("side") + 1)
    rows = kept.groupBy("profile", "id").agg(F.collect_list(F.struct("side", "o", "own", "term", kind.alias("kind"), F.coalesce("tag", "text").alias("text"))).alias("rows"))
    listed = shown.join(rows, ["profile", "id"]).groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("n", "id", "name", "rows"))).alias("best"))  # one more than the limit
    # Each source's own: itself left out, and an item's terms in its own order.
    mine = asks.join(profiles, ["set0", "set1", "tag_set"]).join(settle(listed, "listed"), "profile")
    mine = mine.select("source_id", "list0", "list1", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("source_id")), 1, limit)).alias("at", "x"))
    terms_at = F.array(*(F.split(f"list{k}", " ") for k in (0, 1)))

    def in_order(lists: Column) -> Column:
        at = lambda e: F.when(e["side"] < 2, F.lpad(F.array_position(F.get(lists, e["side"]), e["term"]).cast("string"), 4, "0")).otherwise(e["own"])
        return F.slice(F.sort_array(F.transform("x.rows", lambda e: F.struct(e["side"].alias("side"), e["o"].alias("o"), at(e).alias("at"), e["term"].alias("term"), e["kind"].alias("kind"), e["text"].alias("text")))), 1, MAX_EVIDENCE)

    entries = F.get(F.transform(F.array(terms_at), in_order), F.lit(0))
    evidence = F.transform(entries, lambda e: F.struct(e["kind"].alias("kind"), e["text"].alias("text"), e["term"].alias("term")))
    return mine.select("source_id", (F.col("at") + 1).alias("place"), F.col("x.id").alias("id"), F.col("x.name").alias("name"), evidence.alias("matched_on"))


def match_batch(sources: DataFrame, corpus: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """source_id, id, rank, place, n_terms, first_term for each source's best candidates.

    sources: source_id, text. corpus: id, text, active. Statistics are over the whole corpus, the pool of a source is over
    active rows.
    """
    terms = settle(sources.select("source_id", F.posexplode(terms_of(F.col("text"))).alias("ord", "term")), "terms")
    tokens = settle(corpus.select("id", "active", X.tokens(F.col("text")).alias("t")), "tokens")
    stats = tokens.agg(F.count("*").alias("rows"), F.avg(F.size("t")).alias("mean"))
    # Texts are dealt, once; only tokens that a term reaches are counted, where their row lies.
    words = spread(tokens, ROWS, "id").select("id", F.size("t").alias("len"), "active", F.explode("t").alias("token"))
    reach = settle(_reached(tokens.select(F.lit(0).alias("side"), F.explode("t").alias("token")), terms.select(F.lit(0).alias("side"), "term").distinct()), "reach")
    hits = words.join(reach.drop("side"), "token").groupBy("id", "len", "active", "term").agg(F.count("*").alias("f"))
    hits = settle(hits, "hits")
    idf = hits.groupBy("term").agg(F.count("*").alias("n")).join(F.broadcast(stats)).select("term", "rows", "mean", F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("raw"))
    idf = settle(idf.withColumn("idf", F.expr("if(raw > 0, raw, 1e-6)")), "idf")
    drop(tokens)
    # A candidate's hits lie in one task, so its ranks for all sources are summed there.
    weighed = spread(hits.where("active"), HITS, "id").join(idf, "term").selectExpr("term", "id", "idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) as w")
    scored = weighed.join(terms, "term").groupBy("source_id", "id").agg(F.round(-F.sum("w"), 6).alias("rank"), F.count("*").alias("n_terms"), F.min("ord").alias("ord"))
    place = F.row_number().over(W.partitionBy("source_id").orderBy("rank", "id"))
    best = scored.withColumn("place", place).where(F.col("place") <= min(limit, POOL))
    return best.join(terms, ["source_id", "ord"]).select("source_id", "id", "rank", "n_terms", F.col("term").alias("first_term"), "place")

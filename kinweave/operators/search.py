"""Prefix full-text search ranked by BM25 over token arrays; over an index of postings where one is handed over."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import check_limit
from ..sources.scratch import settle
from . import contacts as C
from .postings import Index, found, scored


def fold(text: str) -> str:
    """norm_text on the driver, for queries."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M").lower()


def split_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", fold(text)) if t]


def prefix_query(query: str) -> list[list[str]] | None:
    """A phrase for each white-space token with a letter or digit; all must occur, the last token of each as a prefix. None: no phrase."""
    cleaned = ("".join(c for c in w if unicodedata.category(c) not in ("Cc", "Cf", "Cs", "Co", "Cn")) for w in query.split())
    return [p for p in map(split_tokens, cleaned) if p] or None


def occurrences(tokens: Column, phrase: Sequence[str]) -> Column:
    """How often a phrase occurs: its tokens side by side, the last one as a prefix."""
    last = len(phrase) - 1
    if last == 0:
        return F.size(F.filter(tokens, lambda t: t.startswith(F.lit(phrase[0]))))

    def count(held: Column) -> Column:
        def here(i: Column) -> Column:
            on = F.get(held, i + last).startswith(F.lit(phrase[last]))
            for k in range(last):
                on = on & (F.get(held, i + k) == phrase[k])
            return F.coalesce(on, F.lit(False))

        places = F.when(F.size(held) > last, F.sequence(F.lit(0), F.size(held) - 1 - last)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(places, here))

    # The array is bound to a variable: inlined into the lambda, it would be cut anew for each place.
    return F.get(F.transform(F.array(tokens), count), F.lit(0))


def ranked(corpus: DataFrame, phrases: Sequence[Sequence[str]], columns: Sequence[str], allowed: Sequence[str] | None = None, any_of: bool = False, key: str = "id") -> DataFrame:
    """key and rank (lower is better) of matching rows. columns: all indexed ones, which give a row's length; allowed: those searched.

    The one-row statistics (rows, average length, rows of each phrase) are over all rows, whatever is filtered later.
    """
    allowed = allowed or columns
    row = corpus.select(key, *(X.tokens(F.col(c)).alias(f"t_{c}") for c in columns))
    row = row.select(key, sum((F.size(f"t_{c}") for c in columns), F.lit(0)).alias("len"), *(sum((occurrences(F.col(f"t_{c}"), p) for c in allowed), F.lit(0)).alias(f"f{k}") for k, p in enumerate(phrases)))
    # Texts are cut once: statistics and ranks both read these counts.
    return scored(settle(row, "frequencies"), len(phrases), any_of, key)


def search(corpus: DataFrame, query: str, columns: Sequence[str], limit: int = 50, key: str = "id", name: str | None = None) -> DataFrame:
    """The best rows for a query; at a tie by name without case, where corpus has one, then by key."""
    check_limit(limit)
    phrases = prefix_query(query)
    name = name or ("name" if "name" in corpus.columns else None)
    kept = corpus.select(key, *([F.col(name).alias("name")] if name else []))
    if phrases is None:
        return kept.select(key, F.lit(0.0).alias("rank")).limit(0)
    rows = ranked(corpus, phrases, columns, key=key).join(kept, key) if name else ranked(corpus, phrases, columns, key=key)
    return rows.orderBy("rank", *([X.nocase(F.col("name"))] if name else []), key).limit(limit).select(key, "rank")


#: The columns of a contact that full-text search reads.
COLUMNS = ("name", "company", "title", "how_we_met", "needs_text", "offers_text")


def listed_by(contacts: DataFrame, needs: DataFrame, offers: DataFrame, contact_tags: DataFrame, tags: DataFrame, query: str | None = None, by: str | None = None, descending: bool = False, limit: int | None = None, index: Index | None = None, **filters) -> DataFrame:
    """Contacts of a list: what fits the filters and, where one is given, the query, with ``position`` and ``total_matches`` if limited.

    Filters hold before the limit. Without an order asked for, a query orders by rank, then name without case, then id; without a
    query names do. A query of white space is none; one without a letter or digit finds nobody.
    """
    check_limit(limit)
    rows = C.filtered(contacts, needs, contact_tags, tags, **filters)
    if not (query or "").strip():
        return C.listed(rows, limit, by or "name", descending)
    phrases = prefix_query(query[:500])
    if phrases is None:
        rows = rows.limit(0).withColumn("rank", F.lit(0.0))
    else:
        ranks = found(index, phrases) if index else ranked(indexed_text(contacts, needs, offers), phrases, COLUMNS)
        rows = rows.join(ranks, "id")
    return C.listed(rows, limit, by or "rank", descending)


def indexed_text(contacts: DataFrame, needs: DataFrame, offers: DataFrame) -> DataFrame:
    """The six searchable columns: resolved items are searchable too, notes never."""
    def joined(items: DataFrame, name: str) -> DataFrame:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])
        return items.groupBy(F.col("contact_id").alias("id")).agg(F.array_join(texts, " ").alias(name))

    return contacts.select("id", "status", "name", "company", "title", "how_we_met").join(joined(needs, "needs_text"), "id", "left").join(joined(offers, "offers_text"), "id", "left")

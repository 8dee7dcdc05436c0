"""Lists, details, boards and statistics over contacts, needs, offers, notes, tags and connections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import STAGES, STATUSES
from .ranks import numbered


def open_items(items: DataFrame) -> DataFrame:
    return items.where("resolved_at is null")


def with_open_count(contacts: DataFrame, needs: DataFrame) -> DataFrame:
    counts = open_items(needs).groupBy("contact_id").agg(F.count("*").alias("open_needs_count")).withColumnRenamed("contact_id", "id")
    return contacts.join(counts, "id", "left").fillna(0, ["open_needs_count"])


def filtered(contacts: DataFrame, needs: DataFrame, contact_tags: DataFrame, tags: DataFrame, *, status: str | None = None, stage: str | None = None, role: str | None = None, city: str | None = None, tag: str | None = None, has_open_needs: bool | None = None) -> DataFrame:
    """Conjunction of what is given; without a status, archived contacts are hidden. A tag that normalises to nothing matches nobody. Contacts that
    have their open_needs_count already are not joined with needs for it."""
    out = contacts.where(F.col("status") == status if status else F.col("status") != "archived")
    if stage:
        out = out.where(F.col("stage") == stage)
    if role:
        out = out.where(F.col("role") == role)
    if city and city.strip():
        out = out.where(X.norm_text(F.col("city")) == X.norm_text(F.lit(city.strip())))
    if tag is not None:
        holders = contact_tags.join(tags.where(F.col("name") == X.tag_name(F.lit(tag))).where("name <> ''"), contact_tags.tag_id == tags.id, "left_semi")
        out = out.join(holders.select(F.col("contact_id").alias("id")), "id", "left_semi")
    if has_open_needs and "open_needs_count" in out.columns:
        out = out.where("open_needs_count > 0")  # the counts say it: needs are read once
    elif has_open_needs is not None:
        out = out.join(open_items(needs).select(F.col("contact_id").alias("id")), "id", "left_semi" if has_open_needs else "left_anti")
    return out


def ordering(by: str = "name", descending: bool = False) -> list[Column]:
    """Nulls last either way; name without case, then id, break ties. Stages go by their domain order."""
    name = X.nocase(F.col("name"))
    if by == "name":
        return [name.desc_nulls_last() if descending else name.asc_nulls_last(), F.col("id").asc()]
    key = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")) if by == "stage" else X.nocase(F.col(by)) if by in ("company", "city") else F.col(by)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), name.asc(), F.col("id").asc()]


def listed(contacts: DataFrame, limit: int | None = None, by: str = "name", descending: bool = False) -> DataFrame:
    """With ``position`` from 1 in the order asked for, and ``total_matches`` before the limit."""
    order = ordering(by, descending)
    if limit is None:
        return contacts.orderBy(*order)
    total = contacts.agg(F.count("*").alias("total_matches"))
    top = contacts.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(W.orderBy(*order))).join(F.broadcast(total))


def tag_lists(contact_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """contact_id and its tag names in order, without case."""
    named = contact_tags.join(tags.withColumnRenamed("id", "tag_id"), "tag_id").distinct()
    pairs = F.array_sort(F.collect_list(F.struct(X.nocase(F.col("name")).alias("k"), F.col("name"))))
    return named.groupBy("contact_id").agg(F.transform(pairs, lambda p: p["name"]).alias("tags"))


def oldest_open(items: DataFrame) -> DataFrame:
    return open_items(items).groupBy("contact_id").agg(F.min_by("text", F.struct("created_at", "id")).alias("top_open_need"))


def board(contacts: DataFrame, needs: DataFrame) -> DataFrame:
    """Active contacts by stage, every stage present, with their oldest open need."""
    rows = contacts.where("status = 'active'").join(oldest_open(needs).withColumnRenamed("contact_id", "id"), "id", "left")
    rows = numbered(rows.select("stage", "id", "name", "top_open_need"), [X.nocase(F.col("name")), "id"], "position", ["stage"])
    return _dimension(contacts, "stage", STAGES).join(rows.withColumn("position", F.col("position").cast("int")), "stage", "left")


def _dimension(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    return F.broadcast(spark.createDataFrame([(v, k) for k, v in enumerate(values)], f"{column} string, ord int"))


def counts_by(contacts: DataFrame, column: str) -> DataFrame:
    """Every value of the closed set with its count, also zero."""
    values = STAGES if column == "stage" else STATUSES
    return _dimension(contacts, column, values).join(contacts.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def distinct_cities(contacts: DataFrame) -> DataFrame:
    """One spelling, the smallest, of each city that differs beyond case and diacritics."""
    return contacts.where("city is not null").groupBy(X.norm_text(F.col("city")).alias("key")).agg(F.min("city").alias("city")).orderBy("key")


def detail(contacts: DataFrame, needs: DataFrame, offers: DataFrame, contact_tags: DataFrame, tags: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Nested needs, offers and tags; notes only where they are handed over."""
    def nested(items: DataFrame, name: str) -> DataFrame:
        row = F.struct(F.col("resolved_at").isNotNull().alias("closed"), "created_at", "id", "text", "resolved_at")
        return items.groupBy(F.col("contact_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias(name))

    out = contacts.join(nested(needs, "needs"), "id", "left").join(nested(offers, "offers"), "id", "left").join(tag_lists(contact_tags, tags).withColumnRenamed("contact_id", "id"), "id", "left")
    if notes is not None:
        own = notes.groupBy(F.col("contact_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("occurred_on", "created_at", F.col("id").alias("note_id"), "body")), asc=False).alias("notes"))
        out = out.join(own, "id", "left")
    return out


def incident(connections: DataFrame) -> DataFrame:
    """Each undirected edge seen from both ends."""
    return connections.selectExpr("contact_a_id as contact_id", "contact_b_id as other_id", "id", "note", "created_at").unionByName(connections.selectExpr("contact_b_id as contact_id", "contact_a_id as other_id", "id", "note", "created_at"))


def compact_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row, nulls dropped."""
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def search_tags(tags: DataFrame, prefix: str) -> DataFrame:
    """Tags that begin with the normalised prefix; an empty one gives all."""
    return tags.where(F.col("name").startswith(X.tag_name(F.lit(prefix)))).orderBy(X.nocase(F.col("name")))


def get(contacts: DataFrame, contact_id: int) -> DataFrame:
    """The contact, or no row."""
    return contacts.where(F.col("id") == contact_id)


def require(contacts: DataFrame, contact_id: int) -> DataFrame:
    """The contact; LookupError if there is none."""
    row = get(contacts, contact_id)
    if row.isEmpty():
        raise LookupError(f"no contact with id {contact_id}")
    return row


def by_url(contacts: DataFrame, urls: DataFrame) -> DataFrame:
    """urls (url) with the id of the contact of that address, however it is spelt; of several the smallest."""
    known = contacts.select(F.nullif(X.url_key(F.col("linkedin_url")), F.lit("")).alias("_key"), "id").where("_key is not null").groupBy("_key").agg(F.min("id").alias("id"))
    return urls.withColumn("_key", X.url_key(F.col("url"))).join(known, "_key", "left").drop("_key")


def by_email(contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """emails (email) with the id of the contact that has it, but for white space around the asked one and the case of A to Z; of
    several the smallest. An empty one finds nobody."""
    known = contacts.select(X.nocase(F.col("email")).alias("_key"), "id").where("_key <> ''").groupBy("_key").agg(F.min("id").alias("id"))
    return emails.withColumn("_key", X.nocase(X.trim(F.col("email")))).join(known, "_key", "left").drop("_key")


def connected(connections: DataFrame, contacts: DataFrame) -> DataFrame:
    """Each contact's connections with the other's name, the latest first, then the greatest id (position)."""
    named = incident(connections).join(contacts.select(F.col("id").alias("other_id"), F.col("name").alias("other_name")), "other_id")
    return numbered(named, [F.desc("created_at"), F.desc("id")], "position", ["contact_id"])


def tags_left(tags: DataFrame, contact_tags: DataFrame, contact_id: int, prefix: str = "") -> DataFrame:
    """Tags that begin with the prefix and aren't the contact's yet, in order."""
    own = contact_tags.where(F.col("contact_id") == contact_id).select(F.col("tag_id").alias("id"))
    return search_tags(tags.join(own, "id", "left_anti"), prefix)


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table and, as table ``all``, of all together."""
    each = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        each = one if each is None else each.unionByName(one)
    return each.unionByName(each.agg(F.lit("all").alias("table"), F.sum("n").alias("n")))


def named_pairs(contacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (name_a, name_b, note) as (a, b, note) by the smallest id of each name; pairs with an unknown name are left out."""
    first = contacts.groupBy(X.person_name(F.col("name")).alias("_name")).agg(F.min("id").alias("_id"))
    out = pairs
    for end in ("a", "b"):
        out = out.join(first.toDF(f"_{end}", end), X.person_name(F.col(f"name_{end}")) == F.col(f"_{end}"))
    return out.select("a", "b", "note")


def sorted_items(items: Column) -> Column:
    """A nested list of items, open ones first, then by time, then id."""
    key = lambda x: F.struct(x["resolved_at"].isNotNull().alias("closed"), x["created_at"].alias("at"), x["id"].alias("id"), x.alias("item"))
    return F.transform(F.array_sort(F.transform(items, key)), lambda x: x["item"])


def sorted_notes(notes: Column) -> Column:
    """A nested list of notes, the latest day first, those without a day last."""
    key = lambda x: F.struct(x["occurred_on"].isNotNull().alias("dated"), x["occurred_on"].alias("day"), x["created_at"].alias("at"), x["note_id"].alias("id"), x.alias("note"))
    return F.transform(F.sort_array(F.transform(notes, key), asc=False), lambda x: x["note"])


def replaced_item(items: Column, item: Column) -> Column:
    """The list with an item in place of the one of its id, in order again; an id that it lacks changes nothing."""
    return sorted_items(F.transform(items, lambda x: F.when(x["id"] == item["id"], item).otherwise(x)))


def list_rows(details: DataFrame) -> DataFrame:
    """List rows of details, from their nested lists alone: the open needs counted, tag names kept; offers and notes left out."""
    opened = F.size(F.filter(F.coalesce("needs", F.array().cast(details.schema["needs"].dataType)), lambda x: x["resolved_at"].isNull()))
    rest = [c for c in details.columns if c not in ("needs", "offers", "tags", "notes")]
    return details.select(*rest, opened.alias("open_needs_count"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def moved(cards: DataFrame, moves: DataFrame) -> DataFrame:
    """A board's cards (stage, id, name, position and others) after moves (id, stage): each card leaves its column and is put in the
    other's order; the last move of a card counts (by ``seq``, where moves have it). Unknown ids and moves to where a card is change nothing."""
    seq = F.col("seq") if "seq" in moves.columns else F.lit(0)
    last = moves.dropna(subset=["id", "stage"]).groupBy("id").agg(F.max_by("stage", F.struct(seq, "stage")).alias("_to"))
    rows = cards.where("id is not null").join(last, "id", "left").withColumn("stage", F.coalesce("_to", "stage")).drop("_to", "position", "ord")
    return numbered(rows, [X.nocase(F.col("name")), "id"], "position", ["stage"])


def options_with(options: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows whose text columns, put together, contain a text, without case; a blank one finds all."""
    wanted = needle.strip().lower()
    return options.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))) if wanted else options


def counted_page(rows: DataFrame, limit: int, order: Sequence[Column | str]) -> DataFrame:
    """The first rows in order with total_matches, returned and truncated, so that a cut list says so."""
    total = rows.agg(F.count("*").alias("total_matches"))
    page = rows.orderBy(*order).limit(limit).join(F.broadcast(total))
    return page.withColumns({"returned": F.least("total_matches", F.lit(limit).cast("long")), "truncated": F.col("total_matches") > limit})


# The fields of a contact that calls hand out, and those of a candidate.
CORE = ("id", "name", "status", "stage", "role", "company", "title", "city", "country", "email", "phone", "linkedin_url", "birthday", "how_we_met", "closeness", "source", "last_contact_at")
CANDIDATE = ("id", "name", "role", "company", "title", "city", "stage")


def shaped(details: DataFrame, notes: bool = False) -> DataFrame:
    """json of each detail: core fields, needs and offers with ``open``, tag names; notes only if asked for. Nulls are dropped."""
    item = lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["resolved_at"].isNull().alias("open"), x["resolved_at"].alias("resolved_at"))
    nested = lambda name: F.coalesce(F.transform(name, item), F.array().cast("array<struct<id:bigint,text:string,open:boolean,resolved_at:string>>")).alias(name)
    parts = [*CORE, nested("needs"), nested("offers"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")]
    if notes:
        parts.append(F.transform("notes", lambda n: F.struct(n["note_id"].alias("id"), n["occurred_on"].alias("occurred_on"), n["body"].alias("body"))).alias("notes"))
    return details.select("id", F.to_json(F.struct(*parts)).alias("json"))


def shaped_matches(found: DataFrame, contacts: DataFrame) -> DataFrame:
    """json of each candidate (id, place, matched_on): its contact's short form and the evidence."""
    rows = found.join(contacts.select(F.col("id"), F.struct(*CANDIDATE).alias("contact")), "id")
    return rows.select("place", "id", F.to_json(F.struct("contact", "matched_on")).alias("json"))

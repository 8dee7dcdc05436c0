"""The library's calls as plain functions over the tables of a network: what a tool server or a command line would offer.

A network is a dict of tables: contacts, needs, offers, notes, tags, contact_tags, connections. Reading calls give a DataFrame; changing
ones give the new network. Faults are LookupError (no such row) and ValueError (a value out of bounds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import parse_birthday
from .operators import contacts as C
from .operators import mapping, matching, mutations, postings, resolve, search
from .schemas import CONTACTS, check_limit, validate
from .sources import tabular

Network = dict[str, DataFrame]
#: Contacts in a search, at most and by default; the longest note, need or offer.
SEARCH_MOST, SEARCH_DEFAULT, TEXT_MOST = 50, 20, 2000


def search_contacts(net: Network, query: str | None = None, limit: int = SEARCH_DEFAULT, index: postings.Index | None = None, **filters) -> DataFrame:
    """Compact hits in order: position, id, name, role, company, city, stage, open_needs_count, total_matches."""
    check_limit(limit)
    hits = search.listed_by(net["contacts"], net["needs"], net["offers"], net["contact_tags"], net["tags"], query, limit=min(limit, SEARCH_MOST), index=index, **filters)
    return C.with_open_count(hits, net["needs"]).select("position", "id", "name", "role", "company", "city", "stage", "open_needs_count", "total_matches")


def get_contact(net: Network, contact_id: int, include_notes: bool = False) -> DataFrame:
    """One contact in full. Notes are read only if asked for."""
    row = C.require(net["contacts"], contact_id)
    return C.detail(row, net["needs"], net["offers"], net["contact_tags"], net["tags"], net["notes"] if include_notes is True else None)


def _row(spark: SparkSession, values: dict) -> DataFrame:
    unknown = set(values) - set(CONTACTS.names)
    if unknown:
        raise ValueError(f"no such field: {', '.join(sorted(unknown))}")
    row = spark.createDataFrame([tuple(values.get(f) for f in values)], ", ".join(f"`{f}` {CONTACTS[f].dataType.simpleString()}" for f in values))
    return row.withColumn("birthday", F.coalesce(parse_birthday(F.col("birthday")), F.col("birthday"))) if values.get("birthday") else row


def _checked(row: DataFrame, named: bool) -> DataFrame:
    faults = [e for e in validate(row if named else row.withColumn("name", F.lit("-"))).first().errors]
    if faults:
        raise ValueError("; ".join(faults))
    return row


def create_contact(net: Network, now: str, **values) -> Network:
    spark = net["contacts"].sparkSession
    return net | {"contacts": mutations.insert_contacts(net["contacts"], _checked(_row(spark, values), True), now)}


def update_contact(net: Network, contact_id: int, now: str, **values) -> Network:
    """Changes the fields given; None clears one."""
    if not values:
        raise ValueError("no field to change")
    if "name" in values and not (values["name"] or "").strip():
        raise ValueError("name: required")
    C.require(net["contacts"], contact_id)
    row = _checked(_row(net["contacts"].sparkSession, values), "name" in values)
    patch = row.select(F.lit(contact_id).cast("long").alias("id"), *(F.struct(F.col(c).alias("value")).alias(c) for c in values))
    return net | {"contacts": mutations.update_contacts(net["contacts"], patch, now)}


def set_stage(net: Network, contact_id: int, stage: str, now: str) -> Network:
    return update_contact(net, contact_id, now, stage=stage)


def delete_contact(net: Network, contact_id: int) -> Network:
    return mutations.delete_contacts(net, C.require(net["contacts"], contact_id).select("id"))


def _text(text: str) -> str:
    if not text.strip() or len(text) > TEXT_MOST:
        raise ValueError(f"text: 1 to {TEXT_MOST} characters")
    return text.strip()


def _add_item(net: Network, table: str, contact_id: int, text: str, now: str) -> Network:
    row = C.require(net["contacts"], contact_id).select(F.col("id").alias("contact_id"), F.lit(_text(text)).alias("text"))
    return net | {table: mutations.add_items(net[table], row, now)}


def add_need(net: Network, contact_id: int, text: str, now: str) -> Network:
    return _add_item(net, "needs", contact_id, text, now)


def add_offer(net: Network, contact_id: int, text: str, now: str) -> Network:
    return _add_item(net, "offers", contact_id, text, now)


def _item(net: Network, table: str, item_id: int) -> DataFrame:
    """The id as a table; LookupError if there is no such item."""
    ids = net[table].sparkSession.createDataFrame([(item_id,)], "id long")
    mutations.require(net[table], ids, table.removesuffix("s"))
    return ids


def set_item_resolved(net: Network, table: str, item_id: int, now: str | None) -> Network:
    """Resolves a need or an offer (table: needs, offers) at a time, or reopens it (None)."""
    return net | {table: mutations.set_resolved(net[table], _item(net, table, item_id), now)}


def resolve_need(net: Network, need_id: int, now: str) -> Network:
    return set_item_resolved(net, "needs", need_id, now)


def set_item_text(net: Network, table: str, item_id: int, text: str) -> Network:
    return net | {table: mutations.set_text(net[table], _item(net, table, item_id).withColumn("text", F.lit(_text(text))))}


def delete_item(net: Network, table: str, item_id: int) -> Network:
    """Deletes a need, an offer, a note or a connection (table: needs, offers, notes, connections) by its id."""
    return net | {table: mutations.delete_rows(net[table], _item(net, table, item_id))}


def set_status(net: Network, contact_id: int, status: str, now: str) -> Network:
    """Sets a contact active, archived or imported."""
    return update_contact(net, contact_id, now, status=status)


def add_note(net: Network, contact_id: int, body: str, now: str, occurred_on: str | None = None) -> Network:
    row = C.require(net["contacts"], contact_id).select(F.col("id").alias("contact_id"), F.lit(_text(body)).alias("body"), F.lit(occurred_on).cast("string").alias("occurred_on"))
    notes, contacts = mutations.add_notes(net["notes"], net["contacts"], row, now)
    return net | {"notes": notes, "contacts": contacts}


def tag_contact(net: Network, contact_id: int, tag: str) -> Network:
    """Ties a tag to a contact; a new name becomes a tag."""
    row = C.require(net["contacts"], contact_id).select(F.col("id").alias("contact_id"), F.lit(tag).alias("name"))
    tags = mutations.ensure_tags(net["tags"], row)
    name = mutations.X.tag_name(F.lit(tag))
    links = tags.where(F.col("name") == name).select(F.lit(contact_id).cast("long").alias("contact_id"), F.col("id").alias("tag_id"))
    return net | {"tags": tags, "contact_tags": mutations.link_tags(net["contact_tags"], links)}


def connect(net: Network, a: int, b: int, now: str, note: str | None = None) -> Network:
    spark = net["contacts"].sparkSession
    mutations.require(net["contacts"], spark.createDataFrame([(a,), (b,)], "id long"))
    pair = spark.createDataFrame([(a, b, note)], "a long, b long, note string")
    return net | {"connections": mutations.connect(net["connections"], pair, now)}


def untag_contact(net: Network, contact_id: int, tag_id: int) -> Network:
    """Unties a tag from a contact; the tag stays."""
    C.require(net["contacts"], contact_id)
    row = net["contact_tags"].sparkSession.createDataFrame([(contact_id, tag_id)], "contact_id long, tag_id long")
    return net | {"contact_tags": mutations.unlink_tags(net["contact_tags"], row)}


def search_tags(net: Network, prefix: str = "") -> DataFrame:
    return C.search_tags(net["tags"], prefix)


def board(net: Network) -> DataFrame:
    """Active contacts by stage, with what they need first."""
    return C.board(net["contacts"], net["needs"])


def filter_options(net: Network) -> dict[str, DataFrame]:
    """The cities and tags that lists can be filtered by."""
    return {"cities": C.distinct_cities(net["contacts"]), "tags": C.search_tags(net["tags"], "")}


def find_matches(net: Network, contact_id: int | None = None, query: str | None = None, limit: int = 10) -> DataFrame:
    if not 1 <= limit <= 10:
        raise ValueError("limit: 1 to 10")
    return matching.find_matches(net["contacts"], net["needs"], net["offers"], net["contact_tags"], net["tags"], contact_id=contact_id, query=query, limit=limit)


#: Fixed value: rows that a preview shows.
PREVIEW_ROWS = 10


def preview_import(spark: SparkSession, path: str) -> dict[str, object]:
    """What a file would be read as, before anything is imported: headers, the first rows as they are and as contacts, the suggested
    mapping, the number of rows, warnings. ValueError for a file that is no upload (tabular.check_upload) or has no header."""
    tabular.check_upload(spark, path)
    rows, warnings = tabular.read(spark, path)
    headers = [c for c in rows.columns if c != "row_number"]
    found = mapping.suggest(headers)
    first = rows.orderBy("row_number").limit(PREVIEW_ROWS)
    return {"headers": headers, "rows": first, "mapped": mapping.map_rows(first, found.mapping), "suggestion": found, "problems": mapping.problems(found.mapping), "total_rows": rows.count(), "warnings": warnings}


def import_file(net: Network, spark: SparkSession, path: str, now: str, columns: dict[str, str] | None = None, source: str | None = None, dry_run: bool = False) -> tuple[Network, DataFrame]:
    """The network after an import, and each row's outcome; a dry run leaves the network as it is. ``resolve.report`` lists an outcome's
    errors, skipped rows and matches by name."""
    rows, _ = tabular.read(spark, path)
    found = mapping.suggest([c for c in rows.columns if c != "row_number"])
    mapped = mapping.map_rows(rows, columns or found.mapping)
    outcomes = resolve.replay(net["contacts"], mapped.drop("dropped"))
    if dry_run:
        return net, outcomes
    return net | {"contacts": resolve.applied(net["contacts"], outcomes, now, source or ("linkedin" if not columns and mapping.is_export([c for c in rows.columns if c != "row_number"]) else "csv"))}, outcomes

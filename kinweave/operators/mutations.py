"""Changes as snapshot to snapshot transforms: each takes tables and returns the new ones.

Patches are tables too, so one change and a million go through the same join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import FILLABLE
from ..sources.scratch import settle
from .ranks import numbered


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the last by the column ``seq`` where rows have it, else the one with the greatest values. Rows without a
    key are left out."""
    rest = [c for c in rows.columns if c not in (*keys, "seq")]
    if not rest:
        return rows.select(*keys).dropna().distinct()
    whole = F.struct(*rest)
    one = F.max_by(whole, F.struct("seq", whole)) if "seq" in rows.columns else F.max(whole)
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(one.alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def require(rows: DataFrame, ids: DataFrame, what: str = "contact", column: str = "id") -> None:
    """LookupError if any of the ids (their first column) isn't there; names the ten smallest."""
    asked = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    gone = [r[0] for r in asked.join(rows.select(F.col(column).alias("_id")), "_id", "left_anti").orderBy("_id").limit(10).collect()]
    if gone:
        raise LookupError(f"no {what} with id {', '.join(map(str, gone))}")


def next_ids(existing: DataFrame, new: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    """New rows numbered after the highest id, range by range."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    return numbered(new.drop(key), order, key).join(F.broadcast(top)).withColumn(key, F.col(key) + F.col("top")).drop("top")


def insert_contacts(contacts: DataFrame, new: DataFrame, now: str, imported: bool = False) -> DataFrame:
    """Appends contacts with the defaults: stage new, source manual, status active (imported ones: imported)."""
    defaults = {"status": "imported" if imported else "active", "stage": "new", "source": "manual", "created_at": now, "updated_at": now}
    filled = new.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in new.columns else F.lit(v) for c, v in defaults.items()})
    return contacts.unionByName(next_ids(contacts, filled, ["name"]), allowMissingColumns=True)


def update_contacts(contacts: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """patches: id, and for each field to change a struct<value>; a null struct leaves the field, a null value clears it.
    A contact that was imported turns active unless the patch sets its status; an empty patch changes nothing. Of several patches of
    a contact the latest counts; ids that aren't there change nothing (see require)."""
    patches = latest(patches, "id")
    fields = [c for c in patches.columns if c != "id"]
    both = contacts.join(patches.select("id", *(F.col(c).alias(f"p_{c}") for c in fields)), "id", "left")
    changed = F.lit(False)
    for c in fields:
        changed = changed | F.col(f"p_{c}").isNotNull()
    out = {c: F.when(F.col(f"p_{c}").isNotNull(), F.col(f"p_{c}.value")).otherwise(F.col(c)) for c in fields}
    own_status = F.col("p_status").isNotNull() if "status" in fields else F.lit(False)
    out["status"] = F.when(changed & (F.col("status") == "imported") & ~own_status, F.lit("active")).otherwise(out.get("status", F.col("status")))
    out["updated_at"] = F.when(changed, F.lit(now)).otherwise(F.col("updated_at"))
    return both.select(*(out.get(c, F.col(c)).alias(c) for c in contacts.columns))


def set_status(contacts: DataFrame, ids: DataFrame, status: str, now: str) -> DataFrame:
    hit = contacts.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return hit.withColumns({"status": F.when(F.col("hit"), F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(F.col("hit"), F.lit(now)).otherwise(F.col("updated_at"))}).select(contacts.columns)


def delete_contacts(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Removes contacts and what hangs on them: needs, offers, notes, tag links and connections of either end."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    links = {"contacts": ["id"], "needs": ["contact_id"], "offers": ["contact_id"], "notes": ["contact_id"], "contact_tags": ["contact_id"], "connections": ["contact_a_id", "contact_b_id"]}
    out = dict(tables)
    for name in links.keys() & tables.keys():
        for column in links[name]:
            out[name] = out[name].join(gone, F.col(column) == F.col("gone"), "left_anti")
    return out


def _empty(x: Column) -> Column:
    return F.nullif(x, F.lit("")) if x is not None else x


def enrich(contacts: DataFrame, values: DataFrame, now: str) -> DataFrame:
    """Fills only fields that are null or empty; ``enriched`` says whether any changed. Status and created_at never do. Of several rows
    of values for a contact the latest counts."""
    values = latest(values, "id")
    fields = [c for c in FILLABLE if c in values.columns and c in contacts.columns]
    both = contacts.join(values.select("id", *(F.col(c).alias(f"v_{c}") for c in fields)), "id", "left")
    kind = dict(contacts.dtypes)
    new = {c: F.coalesce(_empty(F.col(c)) if kind[c] == "string" else F.col(c), F.col(f"v_{c}"), F.col(c)) for c in fields}
    enriched = F.lit(False)
    for c in fields:
        enriched = enriched | ~F.col(c).eqNullSafe(new[c])
    return both.select(*(new.get(c, F.when(enriched, F.lit(now)).otherwise(F.col(c)) if c == "updated_at" else F.col(c)).alias(c) for c in contacts.columns), enriched.alias("enriched"))


def add_items(items: DataFrame, new: DataFrame, now: str) -> DataFrame:
    fresh = new.select("contact_id", "text", F.lit(now).alias("created_at"), F.lit(None).cast("string").alias("resolved_at"))
    return items.unionByName(next_ids(items, fresh, ["contact_id", "text"]).select(items.columns))


def set_resolved(items: DataFrame, ids: DataFrame, now: str | None) -> DataFrame:
    """Resolves items at ``now``, or reopens them (None). What is resolved keeps its time."""
    hit = items.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    value = F.coalesce("resolved_at", F.lit(now)) if now else F.lit(None).cast("string")
    return hit.withColumn("resolved_at", F.when(F.col("hit"), value).otherwise(F.col("resolved_at"))).select(items.columns)


def set_text(items: DataFrame, texts: DataFrame) -> DataFrame:
    return items.join(latest(texts, "id").select("id", F.col("text").alias("new_text")), "id", "left").withColumn("text", F.coalesce("new_text", "text")).select(items.columns)


def delete_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Deletes needs, offers, notes or connections by id."""
    return rows.join(ids.select("id"), "id", "left_anti")


def bump_last_contact(contacts: DataFrame, notes: DataFrame) -> DataFrame:
    """last_contact_at moves to the latest note's day, never back; days compare as text."""
    latest = notes.groupBy(F.col("contact_id").alias("id")).agg(F.max("occurred_on").alias("latest"))
    return contacts.join(latest, "id", "left").withColumn("last_contact_at", F.greatest("last_contact_at", "latest")).select(contacts.columns)


def add_notes(notes: DataFrame, contacts: DataFrame, new: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Notes (default day: today's) and the contacts with their last contact moved."""
    fresh = new.select("contact_id", "body", F.coalesce("occurred_on", F.lit(now[:10])).alias("occurred_on"), F.lit(now).alias("created_at"))
    return notes.unionByName(next_ids(notes, fresh, ["contact_id", "body"]).select(notes.columns)), bump_last_contact(contacts, fresh)


def ensure_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Adds the normalised names that are missing; names that normalise to nothing are left out."""
    wanted = names.select(X.tag_name(F.col("name")).alias("name")).where("name <> ''").distinct().join(tags.select("name"), "name", "left_anti")
    return tags.unionByName(next_ids(tags, wanted, ["name"]).select(tags.columns))


def link_tags(contact_tags: DataFrame, links: DataFrame) -> DataFrame:
    return contact_tags.unionByName(links.select(contact_tags.columns)).distinct()


def unlink_tags(contact_tags: DataFrame, links: DataFrame) -> DataFrame:
    return contact_tags.join(links, ["contact_id", "tag_id"], "left_anti")


def connect(connections: DataFrame, pairs: DataFrame, now: str) -> DataFrame:
    """Adds undirected pairs (a, b, note), smaller id first; a known pair takes over a note that is given, of several the latest.
    ValueError if a contact is to be connected with itself."""
    if not pairs.where("a = b").isEmpty():
        raise ValueError("a contact can't be connected with itself")
    rest = [c for c in ("note", "seq") if c in pairs.columns]
    ordered = pairs.select(F.least("a", "b").alias("contact_a_id"), F.greatest("a", "b").alias("contact_b_id"), *rest)
    noted = latest(ordered.where("note is not null"), "contact_a_id", "contact_b_id").withColumnRenamed("note", "new_note")
    new = ordered.select("contact_a_id", "contact_b_id").distinct().join(noted, ["contact_a_id", "contact_b_id"], "left")
    both = connections.join(new, ["contact_a_id", "contact_b_id"], "left").withColumn("note", F.coalesce("new_note", "note")).select(connections.columns)
    fresh = new.join(connections, ["contact_a_id", "contact_b_id"], "left_anti").select("contact_a_id", "contact_b_id", F.col("new_note").alias("note"), F.lit(now).alias("created_at"))
    return both.unionByName(next_ids(connections, fresh, ["contact_a_id", "contact_b_id"]).select(connections.columns))


def waitlist_upsert(entries: DataFrame, new: DataFrame, key: str = "contact", order: str = "at") -> DataFrame:
    """new with ``duplicate``: whether its key was known, in the store or from an earlier row; the first row of a key wins."""
    known = entries.select(key).distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(W.partitionBy(key).orderBy(order)) > 1
    return new.join(known, key, "left").withColumn("duplicate", F.coalesce("known", F.lit(False)) | first).drop("known")


def waitlist_positions(positions: DataFrame, referrals: DataFrame) -> DataFrame:
    """code, position, referrals, effective: ten places up for each referral, the first place at best."""
    counts = referrals.groupBy("code").agg(F.count("*").alias("referrals"))
    return positions.join(counts, "code", "left").fillna(0, ["referrals"]).withColumn("effective", F.greatest(F.lit(1).cast("long"), F.col("position") - 10 * F.col("referrals")))


def bump_referrals(entries: DataFrame, codes: DataFrame) -> DataFrame:
    """Waitlist entries (referral_code, referrals and others) with one referral more for each row of codes (code); unknown codes
    change nothing."""
    more = codes.groupBy(F.col("code").alias("referral_code")).agg(F.count("*").alias("_more"))
    return entries.join(more, "referral_code", "left").withColumn("referrals", F.col("referrals") + F.coalesce("_more", F.lit(0))).select(entries.columns)


def seed(contacts: DataFrame, people: DataFrame, now: str) -> DataFrame:
    """Adds those people whose name and company, both normalised, no contact has; adding them again changes nothing."""
    key = F.concat(X.person_name(F.col("name")), F.lit("::"), X.norm_text(F.coalesce("company", F.lit(""))))
    known = contacts.select(key.alias("_key")).distinct()
    fresh = people.withColumn("_key", key).dropDuplicates(["_key"]).join(known, "_key", "left_anti").drop("_key")
    return insert_contacts(contacts, fresh, now)


def unseed(contacts: DataFrame, people: DataFrame) -> DataFrame:
    """The ids of contacts that seeding these people would add."""
    key = F.concat(X.person_name(F.col("name")), F.lit("::"), X.norm_text(F.coalesce("company", F.lit(""))))
    return contacts.withColumn("_key", key).join(people.select(key.alias("_key")).distinct(), "_key", "left_semi").select("id")


def canonical_hosts(contacts: DataFrame) -> DataFrame:
    """Addresses of the profile network under any of its hosts go to its main host, the rest of the address kept; https ones alone."""
    url = F.col("linkedin_url")
    host = F.lower(F.regexp_extract(url, "^https://([^/]*)", 1))
    own = (host != "www.linkedin.com") & ((host == "linkedin.com") | host.endswith(".linkedin.com"))
    return contacts.withColumn("linkedin_url", F.when(own, F.concat(F.lit("https://www.linkedin.com"), F.regexp_replace(url, "^https://[^/]*", ""))).otherwise(url))


def with_codes(entries: DataFrame, key: str, taken: DataFrame) -> DataFrame:
    """entries with a referral_code each that no other entry and no row of taken (referral_code) has: whoever comes later by key gets
    another one, until all differ."""
    rows = settle(entries.withColumn("_try", F.lit(0)), "codes")
    while True:
        coded = rows.withColumn("referral_code", X.fresh_code(F.col(key).cast("string"), F.col("_try")))
        known = taken.select("referral_code").distinct().withColumn("_known", F.lit(True))
        first = F.row_number().over(W.partitionBy("referral_code").orderBy("_try", key)) > 1
        coded = coded.join(known, "referral_code", "left").withColumn("_again", first | F.coalesce("_known", F.lit(False))).drop("_known")
        if coded.where("_again").isEmpty():
            return coded.drop("_again", "_try")
        rows = settle(coded.withColumn("_try", F.col("_try") + F.col("_again").cast("int")).drop("_again", "referral_code"), "codes")

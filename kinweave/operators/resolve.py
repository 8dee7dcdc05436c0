"""Entity resolution: a cascade by address, e-mail and name, set-based or in row order with a growing index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import FILLABLE, validate
from ..sources.scratch import drop, settle, spread
from .ranks import RANGE, numbered, running_least

#: Fields that identify a person: a match by name alone never writes them.
IDENTITY = ("email", "linkedin_url")
#: What an import may write: the name of a new contact, its day, and what FILLABLE has.
FIELDS = ("name", "stage", "created_at", *FILLABLE)
_KEYS = ("url_key", "email_key", "name_key")


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds url_key, email_key, name_key; empty ones and placeholder e-mails are null and match nothing."""
    mail = X.email(F.col("email"))
    return rows.withColumns({"url_key": F.nullif(X.url_key(F.col("linkedin_url")), F.lit("")), "email_key": F.when(X.looks_like_email(mail), mail), "name_key": F.nullif(X.person_name(F.col("name")), F.lit(""))})


def contradicts(a: str, b: str) -> Column:
    """Both sides have an address, or both an e-mail, and these differ."""
    return F.coalesce(F.col(f"{a}.url_key") != F.col(f"{b}.url_key"), F.lit(False)) | F.coalesce(F.col(f"{a}.email_key") != F.col(f"{b}.email_key"), F.lit(False))


def match(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with contact_id and matched_by (url, email, name or null) against an index that doesn't grow.

    A row comes to its name only if no contact has its address or e-mail, so a namesake fits exactly if it has none where the
    row has one: the least ids of a name's contacts with and without these decide, whatever the number of namesakes.
    """
    known = with_keys(existing)
    rows = with_keys(incoming)
    by_url = known.where("url_key is not null").groupBy("url_key").agg(F.min("id").alias("by_url"))
    by_email = known.where("email_key is not null").groupBy("email_key").agg(F.min("id").alias("by_email"))
    least = {"any": F.lit(True), "no_url": F.col("url_key").isNull(), "no_email": F.col("email_key").isNull(), "bare": F.col("url_key").isNull() & F.col("email_key").isNull()}
    by_name = known.where("name_key is not null").groupBy("name_key").agg(*(F.min(F.when(on, F.col("id"))).alias(k) for k, on in least.items()))
    named = F.when(F.col("url_key").isNull() & F.col("email_key").isNull(), F.col("any")).when(F.col("email_key").isNull(), F.col("no_url")).when(F.col("url_key").isNull(), F.col("no_email")).otherwise(F.col("bare"))
    found = rows.join(by_url, "url_key", "left").join(by_email, "email_key", "left").join(by_name, "name_key", "left").withColumn("by_name", named)
    way = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_email").isNotNull(), "email").when(F.col("by_name").isNotNull(), "name")
    return found.select(*rows.columns, F.coalesce("by_url", "by_email", "by_name").alias("contact_id"), way.alias("matched_by"))


def _given(rows: DataFrame) -> DataFrame:
    """Adds given: the row's fields as text, in the order of FIELDS; what is absent, null or empty is null."""
    return rows.withColumn("given", F.array(*(F.nullif(F.col(f).cast("string"), F.lit("")) if f in rows.columns else F.lit(None).cast("string") for f in FIELDS)))


#: After every row: when a contact that never gets an address, or an e-mail, stops to lack it.
_NEVER = 1 << 61


def _people(known: DataFrame, rows: DataFrame) -> DataFrame:
    """The contacts that the rows' tentative outcomes leave: id, name_key, url_key with url_at, email_key with email_at (from when they
    have it, null: never). A row without a match is a contact from its own number on; the first row that matches a contact by
    address or e-mail and gives what it lacks fills it."""
    made = rows.where("way is null and name_key is not null and not faulty").select(F.col("number").alias("id"), F.col("number").alias("birth"), *_KEYS, "has_url", "has_email")
    gives = rows.where("way in ('url', 'email') and not faulty and (has_url or has_email)")
    first = gives.groupBy(F.col("target").alias("id")).agg(*(F.min(F.when(F.col(f"has_{k}"), F.struct(F.col("number").alias("at"), F.col(f"{k}_key").alias("key")))).alias(f"{k}_fill") for k in ("url", "email")))
    people = known.unionByName(made).join(first, "id", "left")
    out = [F.col("id"), F.col("birth"), F.col("name_key")]
    for k in ("url", "email"):
        filled = ~F.col(f"has_{k}") & F.col(f"{k}_fill.key").isNotNull()
        out += [F.coalesce(f"{k}_key", F.when(filled, F.col(f"{k}_fill.key"))).alias(f"{k}_key"), F.when(F.col(f"{k}_key").isNotNull(), F.col("birth")).when(filled, F.col(f"{k}_fill.at")).alias(f"{k}_at")]
    return people.select(out)


def _round(known: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the match that each finds among the contacts that the outcomes of the rows before it leave.

    An address belongs to whoever had it first. An e-mail's holder is the least id that had it before the row. A name fits the least id
    that, when the row comes, lacks an address where the row has one, and an e-mail likewise. As ids ascend with births, that is the
    least id among all that lack them at least until then. Both are running minima over one key, in order of time or against it.
    Gives the table of those contacts as well.
    """
    people = settle(_people(known, rows), "people")
    by_url = people.where("url_at is not null").groupBy("url_key").agg(F.min(F.struct("url_at", "id")).alias("_url"))
    by_any = people.where("name_key is not null").groupBy("name_key").agg(F.min("id").alias("_any"))
    until = {"u": F.coalesce("url_at", F.lit(_NEVER)), "m": F.coalesce("email_at", F.lit(_NEVER))}
    until["b"] = F.least(until["u"], until["m"])
    nobody = F.lit(None).cast("long").alias("number")
    events = people.where("email_at is not null").select(F.concat(F.lit("e:"), "email_key").alias("key"), (2 * F.col("email_at") + 1).alias("o"), "id", nobody)
    for kind, end in until.items():
        events = events.unionByName(people.where(F.col("name_key").isNotNull() & (end > F.col("birth"))).select(F.concat(F.lit(f"{kind}:"), "name_key").alias("key"), (-2 * end).alias("o"), "id", nobody))
    kind = F.when(F.col("url_key").isNotNull() & F.col("email_key").isNotNull(), "b").when(F.col("url_key").isNotNull(), "u").when(F.col("email_key").isNotNull(), "m")
    asks = rows.where("name_key is not null")
    nothing = F.lit(None).cast("long").alias("id")
    asked = asks.where("email_key is not null").select(F.concat(F.lit("e:"), "email_key").alias("key"), (2 * F.col("number")).alias("o"), nothing, "number")
    asked = asked.unionByName(asks.where(kind.isNotNull()).select(F.concat(kind, F.lit(":"), "name_key").alias("key"), (1 - 2 * F.col("number")).alias("o"), nothing, "number"))
    told = running_least(events.unionByName(asked), "key", "o", "id").where("number is not null and least is not null")
    told = told.groupBy("number").agg(F.max(F.when(F.col("key").startswith("e:"), F.col("least"))).alias("_email"), F.max(F.when(~F.col("key").startswith("e:"), F.col("least"))).alias("_name"))
    found = rows.join(by_url, "url_key", "left").join(by_any, "name_key", "left").join(told, "number", "left")
    named = F.when(kind.isNull(), F.col("_any")).otherwise(F.col("_name"))
    targets = {"url": F.when(F.col("_url.url_at") < F.col("number"), F.col("_url.id")), "email": F.col("_email"), "name": F.when(named < F.col("number"), named)}
    way = F.when(F.col("name_key").isNull(), F.lit(None))
    for k, target in targets.items():
        way = way.when(target.isNotNull(), k)
    target = F.when(F.col("name_key").isNotNull(), F.coalesce(*targets.values()))
    return found.select(*(c for c in rows.columns if c not in ("way", "target")), way.alias("way"), target.alias("target")), people


def _matched(known: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with the way and target of their match, as if they came one after another.

    Each round takes all rows at once, against the outcomes of the round before; at first every row is a new contact. What a row finds
    depends on earlier rows alone, so after k rounds all rows are right that at most k others lie behind, one waiting for the next; when a
    round changes nothing, all are. Few rounds do, whatever the number of rows of a name, an e-mail or an address.
    """
    rows = settle(rows.withColumns({"way": F.lit(None).cast("string"), "target": F.lit(None).cast("long")}), "round")
    mark = None
    while True:
        fresh, people = _round(known, rows)
        fresh = settle(fresh, "round")
        drop(rows, people)
        rows = fresh
        seen = rows.agg(F.sum(F.xxhash64("number", "way", "target").cast("decimal(38,0)"))).first()[0]
        if seen == mark:
            return rows
        mark = seen


def replay(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """row_number, outcome, contact_id, matched_by, reason, written of each incoming row (row_number, name and any of FIELDS),
    as if rows came one after another and each were visible to the next.

    A row that matches nobody is created; one that fills an empty field of its match is enriched; any other is skipped. A row whose
    values break the limits of contacts is an error and changes nothing. written has the fields a row wrote. All rows are decided
    side by side in rounds of joins and running minima (``_matched``), so rows that share a name, an address or an e-mail, however
    many, do not meet in one task. New ids follow the highest, in row order. Row numbers are different and from 0.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    existing, incoming = (df.withColumns({c: F.lit(None).cast("string") for c in IDENTITY if c not in df.columns}) for df in (existing, incoming))
    checked = validate(_given(incoming)).withColumn("errors", F.filter("errors", lambda e: e != "name: required"))
    has = {"has_url": F.get("given", F.lit(FIELDS.index("linkedin_url"))).isNotNull(), "has_email": F.get("given", F.lit(FIELDS.index("email"))).isNotNull()}
    known = settle(with_keys(_given(existing)).withColumns(has).join(F.broadcast(top)).select("id", F.col("top").alias("birth"), *_KEYS, *has, "given"), "known")
    rows = with_keys(checked).join(F.broadcast(top)).select((F.col("top") + F.col("row_number") + 1).alias("number"), F.col("row_number").cast("long").alias("row_number"), *_KEYS, "given", "errors")
    rows = settle(rows.withColumns(has).withColumns({"faulty": F.size("errors") > 0}), "rows")
    # Contacts that no row shares a key with stay out.
    keys = lambda df: F.explode(F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k))) for k in _KEYS)))).alias("key")
    near = known.select("id", keys(known)).join(rows.select(keys(rows)).distinct(), "key", "left_semi").select("id").distinct()
    near = settle(known.drop("given").join(near, "id", "left_semi"), "near")
    state = _matched(near, rows.drop("given", "errors", "row_number"))
    matched = rows.join(state.select("number", "way", "target"), "number")
    # A match by name alone never writes identity, nor can it fail for it.
    faults = F.filter("errors", lambda e: (F.coalesce(F.col("way"), F.lit("")) != "name") | ~F.substring_index(e, ":", 1).isin(*IDENTITY))
    entries = F.filter(F.transform(F.arrays_zip(F.array(*map(F.lit, FIELDS)).alias("field"), "given"), lambda x: F.struct(x["field"].alias("field"), x["given"].alias("value"))), lambda x: x["value"].isNotNull())
    matched = matched.select("number", "row_number", "name_key", "way", "target", F.array_join(faults, "; ").alias("faults"), entries.alias("fields"))
    withheld = F.exists("fields", lambda x: x["field"].isin(*IDENTITY)) & (F.col("way") == "name")
    kept = F.filter("fields", lambda x: (F.coalesce(F.col("way"), F.lit("")) != "name") | ~x["field"].isin(*IDENTITY))
    outcome = F.when(F.col("name_key").isNull(), "skipped").when(F.col("faults") != "", "error").when(F.col("way").isNull(), "created").otherwise("matched")
    matched = settle(matched.select("number", "row_number", "way", "faults", outcome.alias("outcome"), F.when(outcome == "created", F.col("number")).otherwise(F.col("target")).alias("target"), kept.alias("fields"), withheld.alias("withheld")), "matched")
    # The first row that gives a field which its contact lacks writes it: a row of numbers for each contact, beside the names of what it has.
    given = F.transform("fields", lambda x: x["field"])
    offers = spread(matched.where("outcome = 'matched'").select("number", "target", given.alias("names")), RANGE, "number")
    first = offers.groupBy("target").agg(*(F.min(F.when(F.array_contains("names", f), F.col("number"))).alias(f) for f in FIELDS))
    names = F.array(*map(F.lit, FIELDS))
    held = known.select(F.col("id").alias("target"), F.filter(F.transform("given", lambda x, k: F.when(x.isNotNull(), F.get(names, k))), lambda x: x.isNotNull()).alias("held"))
    held = held.unionByName(matched.where("outcome = 'created'").select("target", given.alias("held")))
    lacking = [F.when(~F.array_contains("held", f), F.struct(F.col(f).alias("number"), F.lit(1 << k).alias("won"))) for k, f in enumerate(FIELDS)]
    wins = first.join(held, "target").select(F.inline(F.filter(F.array(*lacking), lambda x: x["number"].isNotNull())))
    wins = wins.groupBy("number").agg(F.bit_or("won").alias("won"))  # a bit for each field
    nothing = F.create_map().cast("map<string,string>")
    filled = F.when(F.col("won").isNotNull(), F.map_from_entries(F.filter("fields", lambda x: F.getbit("won", F.array_position(names, x["field"]) - 1) > 0)))
    written = F.when(F.col("outcome") == "created", F.map_from_entries("fields")).otherwise(F.coalesce(filled, nothing))
    ended = F.when(F.col("outcome") != "matched", F.col("outcome")).when(F.col("won").isNotNull(), "enriched").otherwise("skipped")
    reason = F.when(F.col("outcome") == "error", F.col("faults")).when(F.col("outcome") == "skipped", "no name").when((F.col("outcome") == "matched") & F.col("won").isNull(), F.when(F.col("withheld"), "identity withheld").otherwise("nothing new"))
    done = matched.join(wins, "number", "left").select("row_number", ended.alias("outcome"), F.col("target").alias("contact_id"), F.col("way").alias("matched_by"), reason.alias("reason"), F.when(F.col("outcome").isin("error", "skipped"), nothing).otherwise(written).alias("written"))
    # Final ids: created rows counted in row order; those of later matches follow their creator.
    done = settle(done, "outcomes")
    made = numbered(done.where("outcome = 'created'").select("row_number", F.col("contact_id").alias("made")), ["row_number"], "place")
    renamed = made.join(F.broadcast(top)).select("made", (F.col("top") + F.col("place")).alias("final"))
    drop(known, near, state)
    return done.join(renamed, F.col("contact_id") == F.col("made"), "left").select("row_number", "outcome", F.coalesce("final", "contact_id").alias("contact_id"), "matched_by", "reason", "written")


def applied(contacts: DataFrame, outcomes: DataFrame, now: str, source: str = "csv") -> DataFrame:
    """The contacts after the outcomes of a replay against them: empty fields filled, created rows appended as imported ones. A dry
    run is a replay that isn't applied."""
    wrote = outcomes.where("outcome in ('created', 'enriched')")
    fills = wrote.groupBy(F.col("contact_id").alias("id")).agg(F.map_from_entries(F.flatten(F.collect_list(F.map_entries("written")))).alias("fills"))  # a field is written once
    kind = dict(contacts.dtypes)
    new = {c: F.coalesce(F.nullif(F.col(c), F.lit("")) if kind[c] == "string" else F.col(c), F.try_element_at("fills", F.lit(c)).cast(kind[c])) for c in FIELDS if c in kind and c != "created_at"}
    new["updated_at"] = F.when(F.col("fills").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
    changed = contacts.join(fills, "id", "left").select(*(new.get(c, F.col(c)).alias(c) for c in contacts.columns))
    fixed = {"status": "imported", "stage": "new", "source": source, "created_at": now, "updated_at": now}
    value = lambda c: F.coalesce(F.try_element_at("fills", F.lit(c)), F.lit(fixed.get(c))).cast(kind[c]) if c in FIELDS or c in fixed else F.lit(None).cast(kind[c])
    fresh = fills.join(contacts, "id", "left_anti").select(*(F.col("id") if c == "id" else value(c).alias(c) for c in contacts.columns))
    return changed.unionByName(fresh)


def summary(outcomes: DataFrame) -> DataFrame:
    """One row: total, created, enriched, skipped, errors, matched and the exit code of the import."""
    n = outcomes.agg(F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(a) for o, a in (("created", "created"), ("enriched", "enriched"), ("skipped", "skipped"), ("error", "errors"))), F.count("contact_id").alias("matched"))
    bad = (F.col("errors") > 0) | (F.col("total") > 0) & (F.col("created") + F.col("enriched") + F.col("matched") == 0)
    return n.withColumn("exit_code", bad.cast("int"))


def histogram(outcomes: DataFrame, column: str = "reason") -> DataFrame:
    """Values of a column with their counts and the first row that has each, in order of appearance."""
    return outcomes.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min("row_number").alias("first_row")).orderBy("first_row")


def report(outcomes: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """section, row_number, text of an import: errors, skipped rows, rows matched by name alone, and dropped values of the mapped rows
    (row_number, dropped)."""
    why = F.coalesce("reason", F.lit("no reason given"))
    by_name = F.when(F.col("outcome") == "enriched", F.concat(F.lit("filled contact "), F.col("contact_id").cast("string"))).otherwise(F.concat(F.lit("skipped: "), why))
    line = lambda rows, section, text: rows.select(F.lit(section).alias("section"), "row_number", text.alias("text"))
    out = line(outcomes.where("outcome = 'error'"), "errors", why).unionByName(line(outcomes.where("outcome = 'skipped'"), "skipped", why)).unionByName(line(outcomes.where("matched_by = 'name'"), "name_matches", by_name))
    if mapped is not None:
        dropped = mapped.select("row_number", F.explode("dropped").alias("d"))
        out = out.unionByName(line(dropped, "dropped", F.concat(F.col("d.reason"), F.lit(': "'), F.col("d.value"), F.lit('"'))))
    return out

"""Tables, closed sets and limits of a contact network, and validation as a DataFrame transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.dates import is_day

# The closed sets, in their binding order, with their labels.
STAGES = ("new", "reached_out", "in_touch", "close", "dormant")
STATUSES = ("imported", "active", "archived")
ROLES = ("founder", "investor", "operator", "student", "community", "other")
SOURCES = ("manual", "linkedin", "csv")
LABELS = {
    "new": "Neu", "reached_out": "Angeschrieben", "in_touch": "Im Austausch", "close": "Eng", "dormant": "Eingeschlafen",
    "imported": "Importiert", "active": "Aktiv", "archived": "Archiviert",
    "founder": "Gründer", "investor": "Investor", "operator": "Operator", "student": "Student", "community": "Community", "other": "Sonstige",
    "manual": "Manuell", "linkedin": "LinkedIn", "csv": "CSV",
}
#: The longest texts, in UTF-16 units.
LIMITS = {"name": 200, "company": 200, "title": 200, "city": 120, "country": 120, "email": 320, "phone": 60, "linkedin_url": 500, "how_we_met": 2000}


def _table(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "int": T.IntegerType()}.get(k, T.StringType()), not k.endswith("!")) for n, k in (x.split(":") for x in spec.split())])


CONTACTS = _table("id:long name:string! status:string! stage:string! role:string company:string title:string city:string country:string email:string phone:string linkedin_url:string birthday:string how_we_met:string closeness:int source:string! last_contact_at:string created_at:string! updated_at:string!")
ITEMS = _table("id:long contact_id:long text:string! created_at:string! resolved_at:string")
NOTES = _table("id:long contact_id:long body:string! occurred_on:string created_at:string!")
TAGS = _table("id:long name:string!")
CONTACT_TAGS = _table("contact_id:long tag_id:long")
CONNECTIONS = _table("id:long contact_a_id:long contact_b_id:long note:string created_at:string!")
#: Fields that an import may fill.
FILLABLE = ("role", "company", "title", "city", "country", "email", "phone", "linkedin_url", "birthday", "how_we_met", "closeness", "last_contact_at")


def label(x: Column) -> Column:
    """What a value of a closed set is called; other values stay as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(t) for pair in LABELS.items() for t in pair)), x), x)


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.char_length(x) + F.char_length(F.regexp_replace(x, r"[\x{0}-\x{FFFF}]", ""))


def check_limit(limit: int | None) -> None:
    """ValueError unless a limit is absent or from 1 to 1000."""
    if limit is not None and not (isinstance(limit, int) and 1 <= limit <= 1000):
        raise ValueError("limit: 1 to 1000")


def validate(contacts: DataFrame) -> DataFrame:
    """Adds errors array<string>, empty for a valid row: required texts, longest texts, closed sets, bounds, days of
    the calendar, birthdays with or without a year."""
    checks = [F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("name: required"))]
    for field, most in LIMITS.items():
        if field in contacts.columns:
            checks.append(F.when(utf16_length(F.col(field)) > most, F.lit(f"{field}: too long")))
    for field, allowed in (("stage", STAGES), ("status", STATUSES), ("role", ROLES), ("source", SOURCES)):
        if field in contacts.columns:
            checks.append(F.when(~F.col(field).isin(*allowed), F.lit(f"{field}: unknown value")))
    if "last_contact_at" in contacts.columns:
        checks.append(F.when(F.col("last_contact_at").isNotNull() & ~is_day(F.col("last_contact_at")), F.lit("last_contact_at: not a day")))
    if "birthday" in contacts.columns:
        # Without a year any leap day is one.
        year = F.when(F.col("birthday").startswith("--"), F.concat(F.lit("2000-"), F.substring("birthday", 3, 5))).otherwise(F.col("birthday"))
        checks.append(F.when(year.isNotNull() & ~is_day(year), F.lit("birthday: not a day")))
    if "closeness" in contacts.columns:
        checks.append(F.when(~F.col("closeness").between(1, 5), F.lit("closeness: 1 to 5")))
    return contacts.withColumn("errors", F.array_compact(F.array(*checks)))


def is_web_email(x: Column) -> Column:
    """The stricter e-mail rule of the web forms."""
    return x.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")

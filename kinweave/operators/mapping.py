"""Columns of a foreign table matched to contact fields, and rows projected onto them."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from .search import split_tokens

# Header spellings, folded to letters and digits, of each field.
ALIASES = {
    "first_name": "firstname first vorname givenname forename prenom",
    "last_name": "lastname last nachname surname familyname familienname zuname",
    "name": "name fullname displayname anzeigename contactname kontaktname kontakt person",
    "email": "email emailaddress emailadresse mail mailadresse primaryemail workemail businessemail",
    "linkedin_url": "linkedin linkedinurl linkedinlink linkedinprofile linkedinprofil linkedinprofileurl profileurl profilurl profillink",
    "company": "company companyname firma firmenname unternehmen unternehmensname organisation organization arbeitgeber employer",
    "title": "position title titel jobtitle jobtitel jobbezeichnung berufsbezeichnung stellenbezeichnung funktion currentposition aktuelleposition",
    "city": "city stadt ort wohnort standort location",
    "country": "country land staat nation countryregion",
    "phone": "phone phonenumber telephone tel telefon telefonnummer mobile mobil mobilephone handy",
    "birthday": "birthday birthdate dateofbirth dob geburtstag geburtsdatum",
    "how_we_met": "howwemet kennengelernt wiewirunskennen",
    "created_at": "connectedon connecteddate verbundenam verbundenseit createdat erstelltam kontaktseit",
}
#: Headers of the network export; with at least five of them a bare "url" is the profile's address.
EXPORT_HEADERS = ("firstname", "lastname", "url", "emailaddress", "company", "position", "connectedon")

_lookup = {a: field for field, names in ALIASES.items() for a in names.split()}


class Suggestion(NamedTuple):
    mapping: dict[str, str]
    unmapped: list[str]
    confident: bool


def header_key(header: str) -> str:
    return "".join(split_tokens(header))


def is_export(headers: Sequence[str]) -> bool:
    keys = {header_key(h) for h in headers}
    return {"firstname", "lastname"} <= keys and sum(k in keys for k in EXPORT_HEADERS) >= 5


def suggest(headers: Sequence[str]) -> Suggestion:
    """Each field once, for its first header; other headers stay unmapped. Confident: a name is mapped and nothing is left over."""
    known = _lookup | ({"url": "linkedin_url"} if is_export(headers) else {})
    mapping: dict[str, str] = {}
    for h in headers:
        field = known.get(header_key(h))
        if field and field not in mapping.values():
            mapping[h] = field
    unmapped = [h for h in headers if h not in mapping]
    return Suggestion(mapping, unmapped, bool({"name", "first_name", "last_name"} & set(mapping.values())) and not unmapped)


def problems(mapping: dict[str, str]) -> dict[str, object]:
    """What a mapping made by hand has wrong: fields used twice, no name, a name column that overrides its parts, columns ignored."""
    used = Counter(f for f in mapping.values() if f != "ignore")
    return {"twice": sorted(f for f, n in used.items() if n > 1), "no_name": not {"name", "first_name", "last_name"} & used.keys(), "name_overrides": "name" in used and bool({"first_name", "last_name"} & used.keys()), "ignored": sum(f == "ignore" for f in mapping.values())}


#: Why a value was dropped, by field.
REASONS = {"email": "not an e-mail address", "created_at": "unreadable day"}


def map_rows(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped fields and ``dropped`` array<struct<field, value, reason>>, as projections over the scan.

    Of several columns for a field the first with a value counts; empty becomes null. Cells are cleaned, but a line break within one
    stays; only names become one line. An e-mail keeps its spelling, for it is folded where it is compared; one without form is nulled
    and an unreadable connection day left out, both reported; an unreadable birthday is nulled silently.
    """
    fields = [f for f in dict.fromkeys(mapping.values()) if f != "ignore"]
    kept = [c for c in ("row_number",) if c in rows.columns]
    # Each value, and then what is made of it, is a column of its own, so that rules are not written out for every use.
    value = lambda field: F.coalesce(*(X.nullable(F.col(f"`{h}`")) for h, f in mapping.items() if f == field), F.lit(None).cast("string"))
    values = rows.select(*kept, *(value(f).alias(f"v_{f}") for f in fields))
    made = {"email": X.looks_like_email(X.email(F.col("v_email"))), "created_at": D.parse_day(F.col("v_created_at"))}
    values = values.withColumns({f"m_{f}": x for f, x in made.items() if f in fields})
    given = lambda field: F.col(f"v_{field}") if field in fields else F.lit(None).cast("string")
    out = {"name": X.compose_name(given("name"), given("first_name"), given("last_name"))}
    dropped = []
    for f in fields:
        raw = given(f)
        if f == "email":
            out[f], bad = F.when(F.col("m_email"), raw), raw.isNotNull() & ~F.col("m_email")
        elif f == "created_at":
            out[f], bad = F.col("m_created_at"), raw.isNotNull() & F.col("m_created_at").isNull()
        elif f not in ("name", "first_name", "last_name"):
            out[f] = D.parse_birthday(raw) if f == "birthday" else X.canonical_url(raw) if f == "linkedin_url" else raw
        if f in made:
            dropped.append(F.when(bad, F.struct(F.lit(f).alias("field"), raw.alias("value"), F.lit(REASONS[f]).alias("reason"))))
    empty = F.array().cast("array<struct<field:string,value:string,reason:string>>")
    return values.select(*kept, *(c.alias(f) for f, c in out.items()), (F.array_compact(F.array(*dropped)) if dropped else empty).alias("dropped"))


def dropped_histogram(mapped: DataFrame) -> DataFrame:
    """field, reason, n and the value of the first row, over all dropped values."""
    each = mapped.select("row_number", F.inline("dropped"))
    return each.groupBy("field", "reason").agg(F.count("*").alias("n"), F.min_by("value", "row_number").alias("example"))


def coded(mapping: dict[str, str]) -> str:
    """A mapping as text, for a form's field or a saved import."""
    return json.dumps(mapping, ensure_ascii=False, sort_keys=True)


def decoded(text: str) -> dict[str, str]:
    """A mapping from its text; a target that isn't known is ignored."""
    known = {*_lookup.values(), "linkedin_url", "ignore"}
    return {str(h): f if f in known else "ignore" for h, f in json.loads(text or "{}").items()}

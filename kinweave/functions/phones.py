"""Telephone numbers to international form, and the waitlist's input: an e-mail address or a number; all as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Numbering plans by region: country code, trunk prefix that national forms begin with, international prefix, and the
# form of a number without both. Regions that share a code share a plan.
PLANS = {
    "AT": ("43", "0", "00", r"(?:[1-46-9]\d{3,12}|5\d{4,12})"),
    "DE": ("49", "0", "00", r"[1-9]\d{3,13}"),
    "CH": ("41", "0", "00", r"[2-9]\d{8}"),
    "LI": ("423", "", "00", r"(?:[2378]\d{6}|6\d{8})"),
    "IT": ("39", "", "00", r"(?:0\d{5,10}|[13-8]\d{5,10})"),
    "FR": ("33", "0", "00", r"[1-9]\d{8}"),
    "ES": ("34", "", "00", r"[5-9]\d{8}"),
    "PT": ("351", "", "00", r"[26-9]\d{8}"),
    "NL": ("31", "0", "00", r"[1-9]\d{8}"),
    "BE": ("32", "0", "00", r"(?:4\d{8}|[1-9]\d{7})"),
    "LU": ("352", "", "00", r"[2-9]\d{3,10}"),
    "GB": ("44", "0", "00", r"(?:[1-357-9]\d{9}|[18]\d{8})"),
    "IE": ("353", "0", "00", r"(?:[1-9]\d{6,9})"),
    "DK": ("45", "", "00", r"[2-9]\d{7}"),
    "SE": ("46", "0", "00", r"[1-9]\d{6,9}"),
    "NO": ("47", "", "00", r"[2-9]\d{7}"),
    "FI": ("358", "0", "00", r"[1-9]\d{4,11}"),
    "PL": ("48", "", "00", r"[1-9]\d{8}"),
    "CZ": ("420", "", "00", r"[2-9]\d{8}"),
    "SK": ("421", "0", "00", r"[2-9]\d{8}"),
    "HU": ("36", "06", "00", r"(?:[2-79]\d{8}|[1-9]\d{7})"),
    "SI": ("386", "0", "00", r"[1-9]\d{7}"),
    "HR": ("385", "0", "00", r"[1-9]\d{6,8}"),
    "RO": ("40", "0", "00", r"[2-9]\d{8}"),
    "GR": ("30", "", "00", r"[2-9]\d{9}"),
    "US": ("1", "1", "011", r"[2-9]\d{2}[2-9]\d{6}"),
}


def _by_code(column: int) -> Column:
    return F.create_map(*(F.lit(x) for p in PLANS.values() for x in (p[0], p[column])))


def e164(x: Column, region: str = "AT") -> Column:
    """A number as ``+`` and digits; null for what is none.

    International forms begin with ``+`` or the region's international prefix; no country code begins another, so the code is the
    first of one to three digits that is one. Other forms are the region's own, with or without its trunk prefix. Blanks, hyphens, dots,
    slashes and brackets are skipped, a trunk prefix in brackets too. The rest must have the form of its plan; numbers of regions
    without a plan here are null, as are a null, an empty text and one with any other sign.
    """
    code, trunk, abroad, form = PLANS[region]
    written = X.trim(x)
    plain = F.regexp_replace(F.regexp_replace(written, r"(?<=\d|^\+\d)\s*\(0\)", ""), r"[\s()./‐-―-]", "")
    digits = F.regexp_replace(plain, rf"^(?:\+|{abroad})", "")
    foreign = plain.rlike(rf"^(?:\+|{abroad})")
    codes = F.array(*(F.lit(c) for c in sorted({p[0] for p in PLANS.values()})))
    begins = F.filter(F.array(*(F.substring(digits, 1, n) for n in (1, 2, 3))), lambda c: F.array_contains(codes, c))
    their = F.get(begins, F.lit(0))
    own = F.regexp_replace(plain, f"^{trunk}", "") if trunk else plain
    rest = F.substring(digits, F.char_length(their) + 1, F.char_length(digits))
    # A trunk prefix after the country code is dropped where the plan has one that no number begins with.
    rest = F.when(F.try_element_at(_by_code(1), their) == "0", F.regexp_replace(rest, "^0", "")).otherwise(rest)
    right = F.coalesce(F.rlike(rest, F.concat(F.lit("^"), F.try_element_at(_by_code(3), their), F.lit("$"))), F.lit(False))
    allowed = written.rlike(r"^\+?[\d\s()./‐-―-]+$")
    there = F.when(right, F.concat(F.lit("+"), their, rest))
    here = F.when(own.rlike(f"^{form}$"), F.concat(F.lit(f"+{code}"), own))
    return F.when(allowed, F.when(foreign, there).otherwise(here))


def waitlist_entry(x: Column, region: str = "AT") -> Column:
    """struct(kind, value): an ``email`` in lower case or a ``phone`` in international form; null for neither."""
    raw = X.trim(x)
    mail = raw.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    phone = e164(raw, region)
    kind = lambda name, value: F.struct(F.lit(name).alias("kind"), value.alias("value"))
    return F.when(mail, kind("email", F.lower(raw))).when(phone.isNotNull(), kind("phone", phone))

"""Text normalisation as Column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x{FEFF}]"


def _folding() -> tuple[str, str]:
    """Characters of the basic plane whose decomposition is one base character and marks; Hangul syllables have none."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xA0, 0x10000) if not 0xAC00 <= c <= 0xD7A3]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and unicodedata.category(d[0])[0] != "M" and all(unicodedata.category(m)[0] == "M" for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folding()


def norm_text(x: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.regexp_replace(F.translate(x, _FROM, _TO), r"\p{M}+", ""))


def strip_control(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{Cc}&&[^\t\n\r]]", "")


def strip_search_noise(x: Column) -> Column:
    return F.regexp_replace(x, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]+", "")


def trim(x: Column) -> Column:
    """Trims every Unicode space and the byte order mark."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column) -> Column:
    return trim(F.regexp_replace(x, f"{SPACE}+", " "))


def clean_cell(x: Column) -> Column:
    return trim(strip_control(F.coalesce(x, F.lit(""))))


def nullable(x: Column) -> Column:
    """Cleaned text; empty becomes null."""
    return F.nullif(clean_cell(x), F.lit(""))


def tokens(x: Column) -> Column:
    """Runs of letters and digits of the normalised text."""
    return F.filter(F.split(norm_text(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def person_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(norm_text(x), r"[^\p{L}\p{N}]+", " "))


def tag_name(x: Column) -> Column:
    slug = F.regexp_replace(trim(norm_text(strip_control(x))), f"{SPACE}+", "-")
    return F.regexp_replace(F.regexp_replace(slug, "-+", "-"), "^-|-$", "")


def email(x: Column) -> Column:
    return F.lower(F.regexp_replace(strip_control(x), f"{SPACE}+", ""))


def looks_like_email(x: Column) -> Column:
    """Exactly one @ with something on both sides."""
    return x.rlike(r"^[^@]+@[^@]+$")


def canonical_url(x: Column) -> Column:
    """https unless a scheme is given; lower-case host, its network's host with www.; no query, fragment, port or final
    slashes. What can't be parsed stays, trimmed. Covers addresses that java.net.URI accepts."""
    raw = trim(x)
    full = F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.lower(F.try_parse_url(full, F.lit("HOST")))
    known = F.when((host == "linkedin.com") | host.endswith(".linkedin.com"), F.lit("www.linkedin.com")).otherwise(host)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), "/+$", "")
    scheme = F.lower(F.try_parse_url(full, F.lit("PROTOCOL")))
    return F.when(host.isNull(), raw).otherwise(F.concat(scheme, F.lit("://"), known, path))


def url_key(x: Column) -> Column:
    return F.lower(canonical_url(strip_control(x)))


def header_key(x: Column) -> Column:
    return F.regexp_replace(norm_text(strip_control(x)), r"[^\p{L}\p{N}]+", "")


def compose_name(whole: Column, first: Column, last: Column) -> Column:
    """A name column wins over first and last name."""
    parts = F.concat_ws(" ", F.nullif(clean_cell(first), F.lit("")), F.nullif(clean_cell(last), F.lit("")))
    return collapse(F.coalesce(F.nullif(clean_cell(whole), F.lit("")), parts))


def initials(x: Column) -> Column:
    """First letters of the first and the last part, upper case."""
    parts = F.filter(F.split(trim(x), r"[\s\-_.]+"), lambda p: p.rlike(r"\p{L}"))
    letter = lambda p: F.upper(F.regexp_extract(p, r"\p{L}", 0))
    return F.when(F.size(parts) == 0, F.lit("")).when(F.size(parts) == 1, letter(F.get(parts, F.lit(0)))).otherwise(F.concat(letter(F.get(parts, F.lit(0))), letter(F.element_at(parts, -1))))


def subtitle(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " · ")


def nocase(x: Column) -> Column:
    """Folds ASCII letters only."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def zero_padded(x: Column, width: int = 4) -> Column:
    digits = x.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def checksum(x: Column) -> Column:
    """SHA-256 of a text in UTF-8, in hex."""
    return F.sha2(x, 256)


# Fixed value: letters and digits that aren't taken for each other.
CODE_SIGNS = "23456789ABCDEFGHJKMNPQRSTVWXYZ"


def referral_code(x: Column) -> Column:
    """Eight signs that depend on a value alone, as good as drawn."""
    each = (F.substring(F.lit(CODE_SIGNS), (F.pmod(F.xxhash64(x, F.lit(k)), F.lit(len(CODE_SIGNS))) + 1).cast("int"), F.lit(1)) for k in range(8))
    return F.concat(*each)


def fresh_code(x: Column, tries: Column) -> Column:
    """Another referral code of a value for each number of tries before; none before gives the first."""
    return F.when(tries == 0, referral_code(x)).otherwise(referral_code(F.concat(x, F.lit("#"), tries.cast("string"))))

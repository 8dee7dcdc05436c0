"""Dates as text: reading several spellings, and relative ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, norm_text, strip_control, trim

# Month names and abbreviations, English and German, without diacritics.
_MONTHS = (
    ("jan", "january", "januar", "janner"), ("feb", "february", "februar"), ("mar", "march", "marz", "maerz"), ("apr", "april"),
    ("may", "mai"), ("jun", "june", "juni"), ("jul", "july", "juli"), ("aug", "august"), ("sep", "sept", "september"),
    ("oct", "october", "okt", "oktober"), ("nov", "november"), ("dec", "december", "dez", "dezember"),
)


def _month(word: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, names in enumerate(_MONTHS, 1) for n in names for x in (n, str(k))))
    return F.get(F.array(table[F.regexp_replace(norm_text(word), r"\.$", "")]), F.lit(0))


def _iso(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD for a real date from 1900 to 2999, else null."""
    day = F.regexp_replace(day, r"\.$", "")
    plain = year.rlike("^[0-9]{4}$") & month.rlike("^[0-9]{1,2}$") & day.rlike("^[0-9]{1,2}$")
    text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(plain & year.between("1900", "2999"), F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def parse_day(x: Column) -> Column:
    """ISO-like, German dotted, or with a month's name before or after the day; anything else, ambiguous slashes included, is null."""
    value = trim(strip_control(x))
    iso, dotted = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?:[T\s].*)?$", r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$"
    part = lambda rule, k: F.regexp_extract(value, rule, k)
    words = F.filter(F.split(value, rf"(?:{SPACE}|,)+"), lambda w: w != "")
    at = lambda k: F.get(words, F.lit(k))
    return (
        F.when(value.rlike(iso), _iso(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(value.rlike(dotted), _iso(part(dotted, 3), part(dotted, 2), part(dotted, 1)))
        .when((F.size(words) == 3) & _month(at(0)).isNotNull(), _iso(at(2), _month(at(0)), at(1)))
        .when((F.size(words) == 3) & _month(at(1)).isNotNull(), _iso(at(2), _month(at(1)), at(0)))
    )


def parse_birthday(x: Column) -> Column:
    """--MM-DD without a year stays, any other day is read as such."""
    value = trim(strip_control(x))
    return F.when(value.rlike(r"^--(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"), value).otherwise(parse_day(value))


def is_day(x: Column) -> Column:
    return x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()


def age(day: Column, today: Column) -> Column:
    """struct(unit, n): days below 7, weeks below 30, months below 365, years."""
    d = F.abs(F.datediff(today, day))
    return F.struct(
        F.when(d < 7, F.lit("day")).when(d < 30, F.lit("week")).when(d < 365, F.lit("month")).otherwise(F.lit("year")).alias("unit"),
        F.when(d < 7, d).when(d < 30, F.floor(d / 7)).when(d < 365, F.floor(d / 30)).otherwise(F.floor(d / 365)).cast("int").alias("n"),
    )


def later(old: Column, new: Column) -> Column:
    """The later of two days as text; a missing one loses."""
    return F.greatest(old, new)


# Short month names in German, and the sign for an absent value.
_SHORT = ("Jan", "Feb", "Mrz", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez")
ABSENT = "–"


def is_iso(x: Column) -> Column:
    """A day, or a day and a time, in ISO form."""
    return is_day(x) | x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T") & F.try_to_timestamp(x).isNotNull()


def _of(x: Column) -> Column:
    """The day of a day or time in ISO form, in the session's time zone; null if it is neither."""
    value = trim(x)
    return F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd")).when(is_iso(value), F.try_to_timestamp(value).cast("date"))


def _named(day: Column, month: Column) -> Column:
    return F.concat(day.cast("string"), F.lit(". "), F.element_at(F.array(*map(F.lit, _SHORT)), month))


def shown(x: Column, absent: str = ABSENT) -> Column:
    """A day as text: 14. Mrz 2023."""
    day = _of(x)
    return F.coalesce(F.concat(_named(F.dayofmonth(day), F.month(day)), F.lit(" "), F.year(day).cast("string")), F.lit(absent))


def shown_time(x: Column, absent: str = ABSENT) -> Column:
    """A day with its time, in the session's time zone: 14. Mrz 2023, 09:12. A day alone begins at midnight."""
    value = trim(x)
    at = F.when(is_iso(value), F.coalesce(F.try_to_timestamp(value), F.try_to_date(value, "yyyy-MM-dd").cast("timestamp")))
    return F.when(at.isNull(), F.lit(absent)).otherwise(F.concat(shown(x, absent), F.lit(", "), F.date_format(at, "HH:mm")))


def shown_birthday(x: Column, absent: str = ABSENT) -> Column:
    """A birthday as text, with its year or without: 14. Mrz."""
    value = trim(x)
    month, day = (F.regexp_extract(value, r"^--([0-9]{2})-([0-9]{2})$", k).cast("int") for k in (1, 2))
    bare = F.when(month.between(1, 12) & day.between(1, 31), _named(day, month)).otherwise(F.lit(absent))
    return F.when(value.rlike(r"^--[0-9]{2}-[0-9]{2}$"), bare).otherwise(shown(value, absent))


def input_day(x: Column) -> Column:
    """YYYY-MM-DD of a day or time; empty for anything else."""
    return F.coalesce(F.date_format(_of(x), "yyyy-MM-dd"), F.lit(""))

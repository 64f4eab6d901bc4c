"""Dates in texts, partial dates, and ages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"(?:[a-z]{3,9}\.?\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
#: The words a cutoff is about, how it relates to its date, and how far apart they may stand in a sentence.
_CUTOFF = r"\b(?:built|constructed|completed|occupancy)\b[^.;]{0,60}?(?:on or before|before|prior to|after|on or after)\s+" + _DAY
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_CERTIFICATE = r"(?i)\bcertificates? of occupancy\b"


def parsed_day(text: Column) -> Column:
    """The date of January 31, 1999, Jan. 31 1999 or 1/31/1999; null for others and for days that no month has."""
    low = F.lower(text)
    piece = lambda pattern, i: F.regexp_extract(low, pattern, i)
    named, plain = r"^([a-z]{3})[a-z]*\.?\s+([0-9]{1,2}),?\s+([0-9]{4})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), piece(named, 1))
    iso = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    return F.coalesce(F.when(month > 0, iso(piece(named, 3), month.cast("string"), piece(named, 2))), iso(piece(plain, 3), piece(plain, 1), piece(plain, 2)))


def cutoff_days(text: Column) -> Column:
    """The distinct last days that phrases such as "built on or before <date>" cover, in any case of letters.

    A phrase names what was built, completed or occupied and the date within one sentence; "before" and "prior to"
    end a day earlier; one with "after" states the side that is left out and gives no day.
    """
    found = F.regexp_extract_all(text, F.lit(f"(?i){_CUTOFF}"), F.lit(0))

    def last_day(phrase: Column) -> Column:
        day = parsed_day(F.regexp_extract(phrase, f"(?i){_DAY}$", 0))
        relation = F.lower(F.regexp_extract(phrase, rf"(?i)(on or before|before|prior to|after)\s+{_DAY}$", 1))
        return F.when(relation == "on or before", day).when(relation != "after", F.date_sub(day, 1))

    return F.array_distinct(F.array_compact(F.transform(found, last_day)))


def certificate_day(year: Column, *texts: Column) -> Column:
    """The one cutoff day that a rule's texts give in a year; null if there is none, or more than one.

    A last day of December says no more than the year, so it counts only if a text names a certificate of occupancy.
    """
    given = [F.coalesce(t, F.lit("")) for t in texts]
    days = F.filter(F.array_distinct(F.flatten(F.array(*map(cutoff_days, given)))), lambda d: F.year(d) == year)
    named = F.exists(F.array(*given), lambda t: F.regexp_like(t, F.lit(_CERTIFICATE)))
    day = F.get(days, F.lit(0))
    return F.when((F.size(days) == 1) & (named | (F.date_format(day, "MM-dd") != "12-31")), day)


def stands_in(day: Column, text: Column) -> Column:
    """Whether a text writes the day out, in any case of letters, not behind a letter or digit or before a digit.

    Forms: 2024-09-05; month, day and year with the month's name, its first three letters or Sept, with or without dots, commas
    and leading zeros; day, month, year; and figures with slashes, dashes or dots, the year in two or four digits.
    """
    part = lambda form: F.lower(F.date_format(day, form))
    month = F.concat(F.lit("(?:"), part("MMMM"), F.lit("|"), F.substring(part("MMMM"), 1, 3), F.when(F.month(day) == 9, r"\.?|sept\.?").otherwise(r"\.?"), F.lit(")"))
    figures = F.concat(F.lit("0?"), part("d"))
    forms = [
        part("yyyy-MM-dd"),
        F.concat(month, F.lit(" "), figures, F.lit(",? "), part("yyyy")),
        F.concat(figures, F.lit(" "), month, F.lit(" "), part("yyyy")),
        F.concat(F.lit("0?"), part("M"), F.lit("([/.-])"), figures, F.lit(r"\1(?:"), part("yyyy"), F.lit("|"), part("yy"), F.lit(")")),
    ]
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.concat_ws("|", *forms), F.lit(r")(?!\p{Nd})"))
    return F.regexp_like(F.lower(F.regexp_replace(text, r"[\s\u00a0]+", " ")), pattern)


def padded(partial: Column) -> Column:
    """A date of which only the year, or year and month, may be given: the first day of it."""
    day = F.when(F.length(partial) == 4, F.concat(partial, F.lit("-01-01"))).when(F.length(partial) == 7, F.concat(partial, F.lit("-01"))).otherwise(partial)
    return day.try_cast("date")


def in_force(day: Column, first: Column, until: Column) -> Column:
    """Both ends belong to the interval; a null one is open."""
    return F.coalesce(first <= day, F.lit(True)) & F.coalesce(day <= until, F.lit(True))


def age_flips(year: Column, age: Column) -> Column:
    """The days between which a building of a known year may come of age: its birthday is somewhere in the year."""
    return F.array(F.make_date(year + age, F.lit(1), F.lit(1)), F.make_date(year + age, F.lit(12), F.lit(31)))

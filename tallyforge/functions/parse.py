"""Parsers of raw cells as column expressions. What can't be read is null, never a default."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalized

#: Spellings of channels and units.
CHANNELS = {"farmgate": ("farmgate", "farm", "producer", "producerprice"), "wholesale": ("wholesale", "wholesaler", "bulk"), "retail": ("retail", "retailer", "consumer")}
UNITS = {"kg": ("kg", "kilo", "kilogram"), "litre": ("l", "litre", "liter", "lt"), "piece": ("pc", "piece", "unit", "egg")}
#: Names of months begin with these.
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def price(x: Column) -> Column:
    digits = F.regexp_replace(x, f"[^{string.digits}.-]", "")
    return F.nullif(digits, F.lit("")).try_cast("double")  # a cast of an empty text is an exception of its own


def _once(x: Column, use) -> Column:
    """use(x) with x worked out once, however often it is named."""
    return F.transform(F.array(x), use)[0]


def apart(x: Column) -> Column:
    """x as it is; columns beside it aren't made in one generated method with the steps before and after them, but in small ones, which the JVM compiles."""
    return _once(x, lambda v: v)


def date(x: Column) -> Column:
    """Day that a text tells, by what is in it: where a month is named, the number of four digits is the year and the first of one or
    two the day (else it is the month's first); without one, year, month and day are numbers between slashes or dashes, with the
    year first or last. A time after the day is left out, and a day that isn't in the calendar is null."""
    number = lambda digits: rf"(?<![0-9:]){digits}(?![0-9:])"

    def told(t: Column) -> Column:
        month = F.regexp_extract(t, rf"(?<![a-z])({'|'.join(MONTHS)})[a-z]*", 1)
        place = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("string")
        day = F.coalesce(F.nullif(F.regexp_extract(t, number("([0-9]{1,2})"), 1), F.lit("")), F.lit("1"))
        named = F.array(F.regexp_extract(t, number("([0-9]{4})"), 1), place, day)
        first = F.split(F.regexp_extract(t, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:$|[t\s])", 1), "-")
        last = F.reverse(F.split(F.regexp_extract(t, r"^([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4})$", 1), "[/-]"))
        return F.when(month != "", named).when(t.rlike("^[0-9]{4}"), first).otherwise(last)

    def joined(parts: Column) -> Column:
        return F.when(F.size(parts) == 3, F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")))

    plain = F.trim(x)  # the usual form needs no reading
    other = _once(_once(F.lower(F.when(~plain.rlike(DAY), plain)), told), joined)
    return F.when(plain.rlike(DAY), plain).otherwise(other).try_cast("date")


def _lookup(key: Column, spellings: dict[str, tuple[str, ...]]) -> Column:
    """The name of a spelling, by a constant map, so that the key is worked out once; null if there is none."""
    return F.create_map(*(F.lit(x) for name, forms in spellings.items() for form in forms for x in (form, name)))[key]


def channel(x: Column) -> Column:
    return _lookup(F.replace(normalized(x), F.lit(" "), F.lit("")), CHANNELS)


def unit(x: Column) -> Column:
    """Folded, one plural s dropped, synonyms under one name; blank is null."""
    bare = F.regexp_replace(normalized(x), "s$", "")
    return _once(bare, lambda b: F.coalesce(_lookup(b, UNITS), F.nullif(b, F.lit(""))))


def currency(x: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("RWF")))

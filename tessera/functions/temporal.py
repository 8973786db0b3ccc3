"""Dates in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import contains_any

#: What is removed from a query, in this order.
PHRASES = ("yesterday", "today", "last week", "last month", "last year", "ago", "recent", "recently", "earlier", "before", "previous", r"\d{4}-\d{2}-\d{2}", r"\d+\s+(day|week|month|year)s?\s+ago")
#: A number of units ago; days back to the first and the last day of a relative date, and the rows it takes at most; rows of other dates.
_AGO = r"(\d+)\s+(day|week|month|year)s?\s+ago"

RELATIVE = {"today": (0, 0, 200), "yesterday": (1, 1, 200), "last_week": (7, 0, 300), "last_month": (30, 0, 500), "last_year": (365, 0, 1000)}
DATE_CAP = 500


def window(hint: Column, as_of: str) -> Column:
    """first and last day and the row cap of a hint (as hint() gives it); relative words that RELATIVE lacks mean the last week; nulls for no hint."""
    day = F.lit(as_of[:10]).cast("date")
    made = lambda first, last, cap: F.struct(first.alias("first"), last.alias("last"), F.lit(cap).alias("cap"))
    word = lambda w: made(F.date_sub(day, RELATIVE[w][0]), F.date_sub(day, RELATIVE[w][1]), RELATIVE[w][2])
    relative = word("last_week")
    for w in RELATIVE:
        relative = F.when(hint["value"] == w, word(w)).otherwise(relative)
    none = F.lit(None).cast("date")
    dates = F.when(hint["first"].isNotNull(), made(F.try_to_date(hint["first"]), F.try_to_date(hint["last"]), DATE_CAP))
    return F.coalesce(F.when(hint["kind"] == "relative", relative), dates, made(none, none, DATE_CAP))


def hint(text: Column, as_of: str) -> Column:
    """kind (relative, date, range), value (the relative word), first and last date; null if the text says none."""
    low, day = F.lower(text), F.lit(as_of[:10]).cast("date")
    n = F.try_to_number(F.nullif(F.regexp_extract(low, _AGO, 1), F.lit("")), F.lit("999999")).cast("int")
    unit = F.regexp_extract(low, _AGO, 2)
    iso = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    made = lambda kind, value, first, last: F.struct(F.lit(kind).alias("kind"), F.lit(value).cast("string").alias("value"), first.alias("first"), last.alias("last"))
    none = F.lit(None).cast("string")
    said = lambda d: d.cast("string")
    rel = lambda v: made("relative", v, none, none)
    out = F.when(contains_any(low, ("yesterday", "yday")), rel("yesterday")).when(contains_any(low, ("today", "now", "current")), rel("today"))
    for unit_ in ("week", "month", "year"):
        out = out.when(contains_any(low, (f"last {unit_}", f"past {unit_}")), rel(f"last_{unit_}"))
    for unit_, days in (("day", 1), ("week", 7), ("month", 30)):
        first = F.date_sub(day, n * days)
        last = first if unit_ == "day" else F.date_sub(day, (n - 1) * days)
        out = out.when((unit == unit_) & n.isNotNull(), made("date" if unit_ == "day" else "range", None, said(first), said(last)))
    return out.when(iso != "", made("date", None, iso, iso))


def cleaned(text: Column) -> Column:
    """The text without phrases of time; as it was if under 10 characters are left."""
    out = text
    for p in PHRASES:
        out = F.regexp_replace(out, f"(?i){p}", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) < 10, text).otherwise(out)

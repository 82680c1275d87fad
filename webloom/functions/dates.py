"""Dates as search results and pages write them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The written forms that are tried, in this order.
FORMS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MM.dd.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"]
#: Days of the units that are not exact.
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def tidy(text: Column) -> Column:
    """The date alone: words before a colon, dashes and middle dots, endings of day numbers and month stops go."""
    words = F.transform(
        F.split(F.translate(F.regexp_replace(text, r"(?i)^\s*(?:updated|publiée?)\b[\s:-]*", ""), "·–—\t\n", "     "), " +"),
        lambda w: F.when(w.rlike(r"(?i)^\d+(?:st|nd|rd|th),?$"), F.regexp_replace(w, "[A-Za-z]+", "")).when(w.rlike(r"^[A-Za-z]{3,9}\.,?$"), F.replace(w, F.lit("."), F.lit(""))).otherwise(w),
    )
    return F.btrim(F.array_join(words, " "), F.lit(" .-"))


def written_date(text: Column, as_of: Column) -> Column:
    """A time stamp from ISO text, a written date, or words like ``3 days ago`` counted from ``as_of``."""
    plain = tidy(text)
    iso = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(plain))
    forms = [F.try_to_timestamp(plain, F.lit(f)) for f in FORMS]
    low, amount = F.lower(plain), F.regexp_extract(plain, r"^(?:(?i)about )?(\d+) ", 1).try_cast("int")
    ago = lambda unit: low.rlike(rf"^(about )?\d+ {unit}s? ago$")
    relative = F.when(low == "today", as_of).when(low == "yesterday", as_of - F.expr("interval 1 day"))
    for unit, n in DAYS.items():
        relative = relative.when(ago(unit), as_of - F.make_dt_interval(days=amount * n))
    relative = relative.when(ago("hour"), as_of - F.make_dt_interval(hours=amount)).when(ago("minute"), as_of - F.make_dt_interval(mins=amount))
    return F.coalesce(iso, *forms, relative)


def earlier(a: Column, b: Column) -> Column:
    return F.least(a, b)


def search_range(start: Column, end: Column) -> Column:
    """The date range of a search request."""
    return F.format_string("cdr:1,cd_min:%s,cd_max:%s", F.date_format(start, "MM/dd/yyyy"), F.date_format(end, "MM/dd/yyyy"))


def simple_date(text: Column) -> Column:
    """A time stamp from ISO text, ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``."""
    plain = F.btrim(text)
    iso = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), F.try_to_timestamp(plain))
    return F.coalesce(iso, F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")))

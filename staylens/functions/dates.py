"""Date parsing for review payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staylens.functions.text import trim_ws

# Accepted layouts in the order they are tried.
ISO_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX",
    "yyyy-MM-dd",
]
MONTH_NAME_LAYOUTS = ["MMM d, yyyy", "MMM [ ]d yyyy"]
PLAIN_LAYOUT = "yyyy-MM-dd HH:mm:ss"
RELATIVE = r"(?i)^([+-]?\d+)\s+(day|week|month|year)\S*(?:\s.*)?ago$"


def rfc3339(c: Column) -> Column:
    """Timestamp of an RFC 3339 string, NULL when it is not one."""
    return F.try_to_timestamp(c, F.lit(ISO_LAYOUTS[0]))


def absolute_date(c: Column) -> Column:
    text = trim_ws(c)
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ISO_LAYOUTS]
    tries += [F.try_to_timestamp(F.initcap(text), F.lit(f)) for f in MONTH_NAME_LAYOUTS]
    tries.append(F.try_to_timestamp(text, F.lit(PLAIN_LAYOUT)))
    return F.coalesce(*tries)


def shift_months(ts: Column, months: Column) -> Column:
    """Add calendar months; days past the end of a month roll into the next one."""
    day = F.to_date(ts)
    start = F.add_months(F.trunc(day, "MM"), months)
    moved = F.date_add(start, F.dayofmonth(day) - 1)
    return moved.cast("timestamp") + (ts - F.date_trunc("day", ts))


def relative_date(c: Column, as_of: Column) -> Column:
    """``3 weeks ago`` seen from ``as_of``; NULL when the text is not of that form."""
    text = trim_ws(c)
    n = F.regexp_extract(text, RELATIVE, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(text, RELATIVE, 2))
    days = F.when(unit == "day", n).when(unit == "week", n * 7)
    months = F.when(unit == "month", n).when(unit == "year", n * 12)
    by_days = F.date_sub(F.to_date(as_of), days).cast("timestamp") + (
        as_of - F.date_trunc("day", as_of)
    )
    return F.coalesce(by_days, shift_months(as_of, -months))


def review_date(c: Column, as_of: Column) -> Column:
    """Any accepted date form of a review, NULL when none fits."""
    return F.coalesce(absolute_date(c), relative_date(c, as_of))

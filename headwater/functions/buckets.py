"""Dates, weeks and adaptive time buckets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: timestamp notations tried in order, ISO first, day-first for what is ambiguous
FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "d-MMM-yyyy h:mm a", "d-MMM-yyyy", "M/d/yyyy h:mm a", "d/M/yyyy HH:mm", "d/M/yyyy",
]


def lenient_timestamp(c: Column) -> Column:
    """The first notation that fits, or ten bare digits as Unix seconds; null if none does."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"(?i)\s*(am|pm)$", " $1")
    tried = [F.try_to_timestamp(s, F.lit(f)) for f in FORMATS]
    epoch = F.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(s.cast("long")))
    return F.coalesce(epoch, *tried)


def week_start(c: Column) -> Column:
    """Midnight of the Monday."""
    return F.date_trunc("week", c)


def bucket_kind(days: int) -> str | None:
    """D, 3D, W or M by whole days spanned; none if the span is empty."""
    if days is None or days <= 0:
        return None
    return "D" if days < 7 else "3D" if days < 30 else "W" if days < 90 else "M"


def bucket(c: Column, kind: str, first: date) -> Column:
    """Label of the bucket: the day, the first of three days from ``first``, the Sunday a week ends, the month's end."""
    d = F.to_date(c)
    origin = F.lit(first)
    out = {
        "D": d,
        "3D": F.date_add(origin, (F.floor(F.datediff(d, origin) / 3) * 3).cast("int")),
        "W": F.next_day(F.date_sub(d, 1), "SUN"),
        "M": F.last_day(d),
    }[kind]
    return out.cast("timestamp_ntz")

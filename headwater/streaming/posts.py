"""The stateless and append-only parts of the pipeline on streams of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.operators.normalize import canonical, with_text
from headwater.operators.terms import ensure_text


def cleaned(stream: DataFrame) -> DataFrame:
    """Canonical posts with their normalised text; works on streams and tables alike."""
    return ensure_text(with_text(canonical(stream)))


def weekly_counts(stream: DataFrame, date: str = "Date", cluster: str = "Cluster", late: str = "30 days") -> DataFrame:
    """(Week, Cluster, Count) per Monday week; posts later than ``late`` behind the newest are not counted."""
    week = F.window(date, "7 days", startTime="4 days")  # 1970-01-05 was a Monday
    counts = stream.withWatermark(date, late).groupBy(week.alias("w"), cluster).agg(F.count("*").alias("Count"))
    return counts.select(F.col("w.start").alias("Week"), cluster, "Count")

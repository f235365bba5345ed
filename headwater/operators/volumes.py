"""Counts, volumes, shares, timelines and rankings of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.buckets import bucket, bucket_kind, week_start
from headwater.functions.text import display_label
from headwater.plans.joins import small_side
from headwater.sources.schema import ENGAGEMENT


def attach_clusters(posts: DataFrame, labels: DataFrame, key: str = "row_id", cluster: str = "Cluster") -> DataFrame:
    """The posts with their cluster; posts without one have null."""
    return posts.join(labels.select(key, cluster), key, "left")


def latest_labels(labels: DataFrame, key: str = "row_id", cluster: str = "Cluster", when: str = "clustered_at") -> DataFrame:
    """(key, cluster) of each row's latest run; ties take the larger cluster. Null labels do not count."""
    known = labels.where(F.col(cluster).isNotNull())
    return known.groupBy(key).agg(F.max(F.struct(when, cluster)).alias("m")).select(key, F.col(f"m.{cluster}").alias(cluster))


def cluster_counts(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("Count")).orderBy(cluster)


def narrative_volumes(df: DataFrame, names: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """(Cluster, Volume, Narrative), largest first; a cluster without a name has a null one."""
    counts = df.groupBy(cluster).agg(F.count("*").alias("Volume"))
    return counts.join(small_side(names.select(cluster, "Narrative")), cluster, "left").orderBy(F.desc("Volume"), cluster)


def share_of_total(df: DataFrame, group: str) -> DataFrame:
    counts = df.groupBy(group).agg(F.count("*").alias("Posts"))
    total = F.greatest(F.sum("Posts").over(Window.partitionBy()), F.lit(1))  # over groups, not posts
    return counts.withColumn("Share_pct", F.round(100.0 * F.col("Posts") / total, 2))


def dataset_span(df: DataFrame, date: str = "Date") -> DataFrame:
    """(first, last, days, dated, any_dated) with whole days of 24 hours; nulls and 0 without dates."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    out = df.agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count(date).alias("dated"))
    days = F.floor((micros(F.col("last")) - micros(F.col("first"))) / 86_400_000_000).cast("int")
    return out.select("first", "last", days.alias("days"), "dated", (F.col("dated") > 0).alias("any_dated"))


def timeline(df: DataFrame, date: str = "Date", cluster: str = "Cluster", names: DataFrame | None = None) -> DataFrame:
    """(Cluster, Date, Volume[, Narrative]) per bucket whose length follows the span; no rows if there is no span."""
    span = dataset_span(df, date).first()
    kind = bucket_kind(span.days)
    dated = df.where(F.col(date).isNotNull())
    if kind is None:
        dated, kind = dated.limit(0), "D"
    first = span["first"].date() if span["first"] else None
    out = dated.groupBy(cluster, bucket(F.col(date), kind, first).alias("Date")).agg(F.count("*").alias("Volume"))
    return out if names is None else out.join(small_side(names.select(cluster, "Narrative")), cluster, "left")


def with_week(df: DataFrame, date: str = "Date", out: str = "Week") -> DataFrame:
    """The dated rows with the Monday of their week."""
    return df.where(F.col(date).isNotNull()).withColumn(out, week_start(F.col(date)).cast("timestamp_ntz"))


def weekly_counts(df: DataFrame, week: str = "Week", cluster: str = "Cluster") -> DataFrame:
    return df.groupBy(week, cluster).agg(F.count("*").alias("Count")).orderBy(week, cluster)


def _engagement(df: DataFrame) -> Column:
    there = [F.coalesce(F.col(c), F.lit(0.0)) for c in ENGAGEMENT if c in df.columns]
    return sum(there[1:], there[0]) if there else F.lit(0.0)


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("display_label", display_label(F.col("author"), F.col("display_name")))


def top_posters(df: DataFrame, by: str = "Volume", k: int = 10) -> DataFrame:
    """The ``k`` posters (author, display_label) with most posts or most engagement; ties by their names."""
    value = F.count("*") if by == "Volume" else F.round(F.sum(_engagement(df)), 6)
    grouped = _labelled(df).groupBy("author", "display_label").agg(value.alias(by))
    return grouped.orderBy(F.desc(by), "author", "display_label").limit(k)


def engagement_total(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.round(F.sum(_engagement(df)), 6).alias("Engagement"))


def authors_by_theme(df: DataFrame, names: DataFrame, k: int = 5, cluster: str = "Cluster") -> DataFrame:
    """The ``k`` most frequent authors per theme name (clusters of one name pool together)."""
    counts = df.groupBy(cluster, "author").agg(F.count("*").alias("PostCount"))
    named = counts.join(small_side(names.select(cluster, "Narrative")), cluster, "left")
    order = Window.partitionBy("Narrative").orderBy(F.desc("PostCount"), cluster, "author")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def author_theme_table(df: DataFrame, themes: list, cluster: str = "Cluster") -> DataFrame:
    """Posts per author in each of the given clusters, one column ``theme_<cluster>`` each."""
    pivoted = df.groupBy("author").pivot(cluster, themes).agg(F.count(F.lit(1)))
    return pivoted.select("author", *(F.coalesce(F.col(f"`{t}`"), F.lit(0)).alias(f"theme_{t}") for t in themes))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, columns, hash): changes when the rows do, whatever their order."""
    hashed = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("hash"))

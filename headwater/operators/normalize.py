"""Raw exports and feeds to canonical posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.buckets import lenient_timestamp
from headwater.functions.text import stripped
from headwater.sources.schema import ALIASES, ENGAGEMENT, EXPORT_SNIPPET, EXPORT_TITLE, TEXT_FIELDS, picked


def _first_filled(columns: list[str]) -> Column:
    """Row by row the first of the columns that holds text; empty if none does."""
    return F.coalesce(*(F.nullif(stripped(F.col(f"`{c}`")), F.lit("")) for c in columns), F.lit(""))


def _text(df: DataFrame, aliases: list[str]) -> Column:
    found = picked(df.columns, aliases)
    return stripped(F.col(f"`{found[0]}`")) if found else F.lit("")


def normalize_posts(df: DataFrame, profile: str = "alias", keep: list[str] | None = None) -> DataFrame:
    """Canonical posts of a raw table: texts stripped and never null, engagement never null, dates as instants.

    ``alias`` takes for each field the first accepted header there is; ``export`` prefers a vendor's columns and
    falls back row by row. Rows without title and snippet are dropped, of equal (title, snippet) one is kept.
    """
    if profile == "alias":
        title, snippet, url = (_text(df, ALIASES[k]) for k in ("title", "snippet", "url"))
    elif profile == "export":
        title = _first_filled(picked(df.columns, EXPORT_TITLE)[:1] or picked(df.columns, ALIASES["title"]))
        snippet = _first_filled(picked(df.columns, EXPORT_SNIPPET)[:1] or picked(df.columns, ALIASES["snippet"]))
        url = _text(df, ["parenturl", *ALIASES["url"]])
    else:
        raise ValueError(f"profile: {profile}")
    dates = [lenient_timestamp(F.col(f"`{c}`")) for c in picked(df.columns, ALIASES["date"])]
    both = picked(df.columns, ["alternatedateformat"]), picked(df.columns, ["time"])
    if both[0] and both[1]:
        dates.append(lenient_timestamp(F.concat_ws(" ", F.col(f"`{both[0][0]}`"), F.col(f"`{both[1][0]}`"))))
    amounts = []
    for c in ENGAGEMENT:
        found = picked(df.columns, ALIASES[c])
        value = F.coalesce(F.nullif(stripped(F.col(f"`{found[0]}`")), F.lit("")).cast("double"), F.lit(0.0)) if found else F.lit(0.0)
        amounts.append(value.alias(c))
    posts = df.select(
        *(F.col(k) for k in keep or []), title.alias("Title"), snippet.alias("Snippet"),
        (F.coalesce(*dates) if dates else F.lit(None).cast("timestamp")).alias("Date"), url.alias("URL"),
        _text(df, ALIASES["author"]).alias("author"), _text(df, ALIASES["display_name"]).alias("display_name"), *amounts,
    )
    return first_of_equals(with_text(posts), keep[0] if keep else None)


def canonical(df: DataFrame) -> DataFrame:
    """A table that has the canonical columns already: texts stripped, null engagement 0; other columns stay."""
    return df.withColumns({c: stripped(F.col(c)) for c in TEXT_FIELDS} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ENGAGEMENT})


def with_text(df: DataFrame) -> DataFrame:
    """The posts with a title or a snippet."""
    return df.where((F.length("Title") > 0) | (F.length("Snippet") > 0))


def first_of_equals(df: DataFrame, order: str | None = None, keys: tuple[str, ...] = ("Title", "Snippet")) -> DataFrame:
    """Of rows equal in ``keys`` the first by ``order``, found by an aggregation, so a hot text is combined map-side."""
    if order is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(order, *(c for c in rest if c != order))).alias("__hw")
    return df.groupBy(*keys).agg(least).select(*(F.col(f"__hw.`{c}`").alias(c) if c in rest else F.col(c) for c in df.columns))


def renumbered(df: DataFrame, order: str, out: str = "row_id") -> DataFrame:
    """``df`` with ``out`` = 0..n-1 in the order of a unique column: ranges are sorted in parallel, then offset."""
    inner, base = "__hw_pos", "__hw_part"
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that no use of it is coalesced another way
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn(base, F.spark_partition_id())
    local = ranged.withColumn(inner, F.row_number().over(Window.partitionBy(base).orderBy(order)))
    sizes = local.groupBy(base).agg(F.count("*").alias("__hw_n"))
    before = F.sum("__hw_n").over(Window.orderBy(base)) - F.col("__hw_n")  # one row per partition
    starts = sizes.select(base, before.alias("__hw_start"))
    return local.join(F.broadcast(starts), base).withColumn(out, F.col("__hw_start") + F.col(inner) - 1).drop(inner, base, "__hw_start")

"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A folder of Parquet, or of CSV files with header (arrays joined by ", "), replacing what was there."""
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    flat = [F.concat_ws(", ", c.name).alias(c.name) if isinstance(c.dataType, T.ArrayType) else F.col(c.name) for c in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def chart_feed(df: DataFrame, value: str, *ties: str, limit: int | None = None) -> DataFrame:
    """Rows of a chart, largest first; ties in the order of the given columns."""
    ordered = df.orderBy(F.desc(value), *ties)
    return ordered if limit is None else ordered.limit(limit)


def peak(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """The one row with the largest value; of several the first by the given columns."""
    return chart_feed(df, value, *ties, limit=1)


def bar_label(value: Column) -> Column:
    """The whole number on a bar: rounded, a half to the even one."""
    return F.bround(value, 0).cast("long")


def peak_label(value: Column) -> Column:
    """The whole number on the mark of a peak: without its fraction."""
    return value.cast("long")

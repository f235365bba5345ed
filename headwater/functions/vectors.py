"""Vectors as array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, centroid): the mean vectors, summed per dimension with map-side partial sums."""
    parts = df.select(F.col(cluster), F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("m"))
    return ordered.select(cluster, F.col("m.x").alias("centroid"))

"""Connected components in the core: alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.plans.lineage import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (only the larger, or only the smaller ones) hooked to its least neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where("v <= u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        hooked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hooked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return hooked.where("u != v").distinct()


def components(links: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(node, component) for every end of a link; the component is its smallest node. No links: no rows."""
    edges = cut(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v").distinct())
    while True:
        new = cut(_star(_star(edges, True), False))
        # stars whose leaves all hang on their root no longer change: every edge is there before and after
        both = edges.select("u", "v", F.lit(1).alias("o")).unionAll(new.select("u", "v", F.lit(-1).alias("o")))
        if both.groupBy("u", "v").agg(F.sum("o").alias("o")).where("o != 0").isEmpty():
            break
        edges = new
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

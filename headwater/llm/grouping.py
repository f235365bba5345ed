"""Consolidating pairwise matches into groups: deterministic Borůvka hooking.

Every round each component hooks itself along its smallest outgoing edge (edges are ordered by their two
ends, so the order is total and the only cycles are two components choosing the same edge; the smaller one
stays the root). The trees collapse by pointer doubling, the edges are relabelled to the roots, loops and
repeats fall away, and the rounds go on until no edge is left: at most log2(n) of them.

Scale: an edge is two longs; relabelled edges are deduplicated before the next shuffle, minima are
pre-aggregated map-side, and the only skewed step, relabelling the edges of a hub, is a sort-merge join whose
heavy side AQE splits. Labels, edges and parents never leave the executors; each round is a reliable
checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.plans.lineage import cut


def valid_links(pairs: DataFrame, i: str = "i", j: str = "j", similarity: str = "similarity", threshold: float = 0.90) -> DataFrame:
    """The distinct links (a < b) among rows of pairs.

    No link: an end is null, both ends are equal, or the similarity is null, NaN or below the threshold.
    Repeated and reversed rows are one link.
    """
    s = F.col(similarity).cast("double")
    a, b = F.col(i).cast("long"), F.col(j).cast("long")
    kept = pairs.where(a.isNotNull() & b.isNotNull() & (a != b) & s.isNotNull() & ~F.isnan(s) & (s >= threshold))
    return kept.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _smallest_edges(edges: DataFrame) -> DataFrame:
    """For every component its smallest outgoing edge, as the component at the other end."""
    both = edges.select(F.col("a").alias("c"), "a", "b").unionAll(edges.select(F.col("b").alias("c"), "a", "b"))
    best = both.groupBy("c").agg(F.min(F.struct("a", "b")).alias("e"))
    other: Column = F.when(F.col("e.a") == F.col("c"), F.col("e.b")).otherwise(F.col("e.a"))
    return best.select("c", other.alias("p"))


def _collapse(hooks: DataFrame) -> DataFrame:
    """(c, p) with p the root of c's tree. Two components hooked to each other: the smaller is the root."""
    back = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    parents = hooks.join(back, "p", "left")
    tree = parents.select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    tree = cut(tree)
    while True:
        up = tree.select(F.col("c").alias("p"), F.col("p").alias("root"))
        step = tree.join(up, "p").select("c", F.col("root").alias("p"), (F.col("root") != F.col("p")).alias("moved"))
        step = cut(step)
        moved = not step.where("moved").isEmpty()
        tree = step.select("c", "p")
        if not moved:
            return tree


def connected_groups(links: DataFrame) -> DataFrame:
    """(row_id, group_id) for every end of a link (a, b); group_id is the smallest row_id connected with it.

    No links: an empty table. Nulls must have been removed (:func:`valid_links`).
    """
    edges = cut(links.select("a", "b"))
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("row_id")).distinct().withColumn("c", F.col("row_id")))
    while not edges.isEmpty():
        roots = _collapse(_smallest_edges(edges))
        to = lambda side: roots.select(F.col("c").alias(side), F.col("p").alias(f"{side}_root"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a_root != b_root")
        edges = cut(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        # a component without outgoing edges is finished and keeps its label
        labels = labels.join(roots, "c", "left").select("row_id", F.coalesce("p", "c").alias("c"))
        labels = cut(labels)
    smallest = labels.groupBy("c").agg(F.min("row_id").alias("group_id"))
    return labels.join(smallest, "c").select("row_id", "group_id")


def duplicate_groups(pairs: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Groups of a table of matches (i, j, similarity): row_id, DupGroupID (= smallest member), members."""
    groups = connected_groups(valid_links(pairs, threshold=threshold))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("members"))
    return groups.join(sizes, "group_id").select("row_id", F.col("group_id").alias("DupGroupID"), "members")

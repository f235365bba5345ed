"""Near duplicates by vectors: pairs, groups, survivors and a summary.

The similarity join of vectors is exact: vectors at length one are multiplied block by block in single precision, and
what comes near the threshold is decided in double precision. Dense vectors of few dimensions leave nothing to filter
by (every pivot's cell is visited by every vector), so the join is quadratic, as products of matrices.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.operators.components import components
from headwater.plans.lineage import cut

BLOCK, ROWS, COLUMNS, SLACK = 170_000, 512, 1024, 1e-5  # rows of a block, of a tile, and the most a single-precision cosine is off


def eligible(df: DataFrame, title: str = "Title", snippet: str = "Snippet", min_chars: int = 40) -> DataFrame:
    """The rows with text enough to compare."""
    return df.where(F.length(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))) >= min_chars)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lists) and len(flat) % len(lists):
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _similar_rows(v: np.ndarray, ids: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(similarity, i, j) of the rows ``first`` against ``second`` (the same rows: each pair once), decided in double precision."""
    length = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
    first, second, same = first[length[first] > 0], second[length[second] > 0], first is second
    a = (v[first] / length[first, None]).astype(np.float32)
    b = a if same else (v[second] / length[second, None]).astype(np.float32)
    found = [(np.zeros(0), ids[:0], ids[:0])]
    for r in range(0, len(a), ROWS):
        for c in range(r // COLUMNS * COLUMNS if same else 0, len(b), COLUMNS):
            tile = a[r : r + ROWS] @ b[c : c + COLUMNS].T
            near = np.flatnonzero(tile.ravel() >= np.float32(threshold - SLACK))
            if not len(near):
                continue
            x, y = r + near // tile.shape[1], c + near % tile.shape[1]
            if same:
                x, y = x[x < y], y[x < y]
            x, y = first[x], second[y]
            exact = np.einsum("ij,ij->i", v[x] / length[x, None], v[y] / length[y, None], dtype=np.float64)
            x, y, exact = x[exact >= threshold], y[exact >= threshold], exact[exact >= threshold]
            found.append((exact, np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
    return tuple(np.concatenate(k) for k in zip(*found, strict=True))


def similar_vectors(df: DataFrame, key: str, vector: str, threshold: float = 0.90, block: int = BLOCK) -> DataFrame:
    """(similarity, i, j) with i < j of all rows whose cosine is at least ``threshold``: exact, and quadratic in the rows.

    Rows are dealt into blocks by hash, every two blocks meet in one task. ``key`` is a unique number; null and
    zero vectors have no partner.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("v is not null")
    blocks = max(1, math.ceil(df.select(key).count() / block))  # of the key alone: no vector is made for it
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("id", "v", own.alias("own"), met.alias("other"))
    dealt = dealt.select("id", "v", "own", (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("unit"))

    def compare(unit: tuple, rows: pa.Table) -> pa.Table:
        p, q = divmod(unit[0].as_py(), blocks)
        of = rows["own"].to_numpy()
        first = np.flatnonzero(of == p)
        second = first if p == q else np.flatnonzero(of == q)
        similarity, i, j = _similar_rows(_matrix(rows["v"]), rows["id"].to_numpy(), first, second, threshold)
        return pa.table({"similarity": similarity, "i": i, "j": j})

    spaced = dealt.repartition(4 * blocks * (blocks + 1) // 2, "unit")  # so that few tasks get two units
    return spaced.groupBy("unit").applyInArrow(compare, "similarity double, i long, j long")


def duplicate_groups(pairs: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """(DupGroupID, Index, Title, URL, Cluster) of all rows in groups of two or more.

    A group's number is the number of components, rows without a partner included, that begin before it.
    """
    found = components(pairs)
    starts = rows.select(F.col(key).alias("node")).join(found, "node", "left").where("component is null or component = node").select("node")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that no use of it is coalesced another way
    order = cut(starts).repartitionByRange(parts, "node").withColumn("part", F.spark_partition_id())
    local = order.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("node")))
    sizes = local.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    numbered = local.join(F.broadcast(before), "part").select(F.col("node").alias("component"), (F.col("before") + F.col("k") - 1).cast("int").alias("DupGroupID"))
    members = found.join(numbered, "component")
    about = rows.select(
        F.col(key).alias("node"), F.col("Title") if "Title" in rows.columns else F.lit("").alias("Title"),
        F.col("URL") if "URL" in rows.columns else F.lit("").alias("URL"), F.col("Cluster") if "Cluster" in rows.columns else F.lit(None).cast("int").alias("Cluster"),
    )
    return members.join(about, "node").select("DupGroupID", F.col("node").alias("Index"), "Title", "URL", "Cluster")


def deduplicated(rows: DataFrame, pairs: DataFrame, key: str = "row_id", title: str = "Title", snippet: str = "Snippet") -> DataFrame:
    """``rows`` without those a longer member of their group (of equals: the first) stands for; all others stay."""
    length = F.length(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))).alias("length")
    members = components(pairs).join(rows.select(F.col(key).alias("node"), length), "node")
    best = members.groupBy("component").agg(F.max(F.struct("length", (-F.col("node")).alias("n"))).alias("m"))
    kept = best.select("component", (-F.col("m.n")).alias("kept"))
    gone = members.join(kept, "component").where("node != kept").select(F.col("node").alias(key))
    return rows.join(gone, key, "left_anti")


def dedup_summary(before: DataFrame, after: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """(Cluster, Before, After, Removed, Pct_Removed); the percentage is null where there was nothing before."""
    tagged = before.select(cluster, F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select(cluster, F.lit(0).alias("b"), F.lit(1).alias("a")))
    both = tagged.groupBy(cluster).agg(F.sum("b").alias("Before"), F.sum("a").alias("After"))
    removed = F.col("Before") - F.col("After")
    return both.select(cluster, "Before", "After", removed.alias("Removed"), F.round(100.0 * removed / F.nullif(F.col("Before"), F.lit(0)), 2).alias("Pct_Removed"))

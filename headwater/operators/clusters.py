"""k-means, central posts, projection and extractive summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.text import candidate_line, first_sentence, jaccard, same_line_key, stripped, summary_tokens
from headwater.functions.vectors import centroids, cosine, dot
from headwater.plans.joins import small_side


def kmeans(df: DataFrame, k: int = 6, key: str = "row_id", vector: str = "embedding", seed: int = 42, restarts: int = 10) -> DataFrame:
    """(key, Cluster) of the cheapest of ``restarts`` runs; fewer rows than ``k`` are an error. Numbers are arbitrary."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(F.col(key), array_to_vector(vector).alias("features")).persist()
    try:
        if data.limit(k).count() < k:
            raise ValueError(f"fewer than {k} rows")
        models = [KMeans(k=k, seed=seed + r, maxIter=300, tol=1e-4, featuresCol="features", predictionCol="Cluster").fit(data) for r in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()
    return best.transform(df.select(F.col(key), array_to_vector(vector).alias("features"))).select(key, "Cluster")


def projection(df: DataFrame, key: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(key, x, y) by the first two principal components (a linear stand-in for a neighbour embedding)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.select(F.col(key), array_to_vector(vector).alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="xy").fit(data).transform(data).withColumn("xy", vector_to_array("xy"))
    return out.select(key, F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))


def central(df: DataFrame, k: int = 5, key: str = "row_id", cluster: str = "Cluster", vector: str = "embedding", measure: str = "dot") -> DataFrame:
    """(cluster, rank, key, score): the ``k`` rows nearest to each cluster's mean, by product or cosine (6 digits); ties take the larger key."""
    means = centroids(df, cluster, vector)
    by = {"dot": dot, "cosine": cosine}[measure]
    scored = df.join(small_side(means, 20_000), cluster).select(cluster, key, F.round(by(F.col("centroid"), F.col(vector)), 6).alias("score"))
    w = Window.partitionBy(cluster).orderBy(F.desc("score"), F.desc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(cluster, "rank", key, "score")


def representative_texts(posts: DataFrame, ranked: DataFrame, key: str = "row_id", cluster: str = "Cluster") -> DataFrame:
    """(cluster, texts): title and first sentence of the central posts, in their order."""
    line = stripped(F.concat_ws(" ", F.coalesce("Title", F.lit("")), first_sentence(F.col("Snippet"))))
    rows = ranked.select(cluster, "rank", key).join(posts.select(key, line.alias("line")), key)
    return rows.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("t")).select(cluster, F.col("t.line").alias("texts"))


def summarize(posts: DataFrame, label: str = "Cluster", key: str = "row_id", vector: str = "embedding", top_k: int = 5) -> DataFrame:
    """(Idea, Narrative, Posts, Share_pct, Examples): of each idea's central posts the line most like the others.

    Lines equal but for case and spaces count once; equal likeness takes the more central line.
    """
    named = posts.where(F.col(label).isNotNull()).withColumn("Idea", F.col(label).cast("string"))
    ranked = central(named, top_k, key, "Idea", vector, "cosine")
    about = named.select(key, candidate_line(F.col("Title"), F.col("Snippet")).alias("line"), F.coalesce("Title", F.lit("")).alias("Title"))
    lines = ranked.select("Idea", "rank", key).join(about, key)
    once = lines.groupBy("Idea", same_line_key(F.col("line")).alias("same")).agg(F.min(F.struct("rank", "line")).alias("m"))
    once = once.select("Idea", F.col("m.rank").alias("rank"), F.col("m.line").alias("line"), summary_tokens(F.col("m.line")).alias("words"))
    other = once.select("Idea", F.col("rank").alias("r"), F.col("words").alias("w"))
    # at most top_k lines an idea
    likeness = once.join(other, "Idea", "left").where("rank != r").groupBy("Idea", "rank").agg(F.avg(jaccard(F.col("words"), F.col("w"))).alias("like"))
    rated = once.join(likeness, ["Idea", "rank"], "left").select("Idea", "line", "rank", F.coalesce("like", F.lit(0.0)).alias("like"))
    best = rated.groupBy("Idea").agg(F.max(F.struct(F.round("like", 9).alias("like"), (-F.col("rank")).alias("r"), "line")).alias("m")).select("Idea", F.col("m.line").alias("Narrative"))
    shown = lines.groupBy("Idea").agg(F.sort_array(F.collect_list(F.struct("rank", "Title"))).alias("t"))
    shown = shown.select("Idea", F.concat_ws(" | ", F.slice("t.Title", 1, 3)).alias("Examples"))
    sizes = named.groupBy("Idea").agg(F.count("*").alias("Posts"))
    total = F.greatest(F.sum("Posts").over(Window.partitionBy()), F.lit(1))  # one row per idea
    sizes = sizes.withColumn("Share_pct", F.round(100.0 * F.col("Posts") / total, 2))
    return sizes.join(best, "Idea").join(shown, "Idea").select("Idea", "Narrative", "Posts", "Share_pct", "Examples").orderBy(F.desc("Posts"), "Idea")

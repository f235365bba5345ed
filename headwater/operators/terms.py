"""TF-IDF terms of clusters, each cluster its own corpus, as aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.text import normalized, term_words, with_pairs
from headwater.plans.joins import small_side
from headwater.plans.lineage import cut, spread

LISTED = 1_000_000  # (cluster, term) whose weights a task can hold, about 150 MB


def ensure_text(df: DataFrame, title: str = "Title", snippet: str = "Snippet", out: str = "_text_norm") -> DataFrame:
    """``df`` with the normalised title and snippet; a column of that name is kept as it is."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    return df if out in df.columns else df.withColumn(out, normalized(both))


def tfidf_scores(df: DataFrame, key: str = "row_id", cluster: str = "Cluster", text: str = "_text_norm", max_df: float = 0.8, listed: int = LISTED) -> DataFrame:
    """(cluster, term, score): mean over the cluster's documents of the length-normalised tf-idf weights.

    A term counts if at least two documents (one, if there are fewer than five) and at most ``max_df`` of them
    hold it. A document is one row and is weighted within it: what is shuffled are the document frequencies and
    one sum per task and (cluster, term). More than ``listed`` (cluster, term) are too many to send to every task; then
    documents are taken apart and meet the frequencies in a join, with the same result.
    """
    words = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), term_words(F.col(text)).alias("words"))
    docs = words.select("c", with_pairs(F.col("words")).alias("tokens"))
    sizes = df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"))
    frequency = docs.select("c", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("c", "term").agg(F.count("*").alias("df"))
    least = F.when(F.col("n") < 5, 1).otherwise(2)
    idf = (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf")
    counted = frequency.join(small_side(sizes), "c")
    kept = cut(counted.where((F.col("df") >= least) & (F.col("df") <= max_df * F.col("n"))).select("c", "term", idf, "n"))
    if kept.count() <= listed:
        shares = _weighed_in_rows(docs, kept)
    else:
        marked = docs.withColumn("id", F.monotonically_increasing_id())
        shares = _weighed_by_join(marked, kept)
    totals = shares.groupBy("c", "term").agg(F.sum("w").alias("w")).join(small_side(sizes), "c")
    return totals.select(F.col("c").alias(cluster), "term", (F.col("w") / F.col("n")).alias("score"))


def _weighed_in_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(c, term, w): per task the sums of the weights of its documents (c, tokens); ``kept`` (c, term, idf) goes to every task."""
    table = kept.select("c", "term", "idf").toPandas()
    kind = docs.schema["c"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast({c: dict(zip(g["term"], g["idf"], strict=True)) for c, g in table.groupby("c")})

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {c: {} for c in shared.value}
        for b in batches:
            for c, tokens in zip(b["c"], b["tokens"], strict=True):
                idf, mine = shared.value.get(c), sums.get(c)
                if idf is None:
                    continue
                found: dict[str, float] = {}
                for t in tokens:
                    i = idf.get(t)
                    if i is not None:
                        found[t] = found.get(t, 0.0) + i
                length = math.sqrt(sum(w * w for w in found.values()))
                for t, w in found.items():
                    mine[t] = mine.get(t, 0.0) + w / length
        for c, mine in sums.items():
            if mine:
                yield pd.DataFrame({"c": c, "term": list(mine), "w": list(mine.values())})

    return spread(docs).mapInPandas(weigh, f"c {kind}, term string, w double")


def _weighed_by_join(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(c, term, w) of every document (c, id, tokens) and term, by a join with ``kept`` (c, term, idf)."""
    tf = docs.select("c", "id", F.explode("tokens").alias("term")).groupBy("c", "id", "term").agg(F.count("*").alias("tf"))
    weighted = tf.join(kept, ["c", "term"]).select("c", "id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("c", "id")))
    return weighted.select("c", "term", (F.col("w") / length).alias("w"))


def top_terms(df: DataFrame, n_terms: int = 12, **kw) -> DataFrame:
    """(cluster, rank, term, score) of the best terms of each cluster; equal scores (to nine digits) by term, last first."""
    cluster = kw.get("cluster", "Cluster")
    scored = tfidf_scores(df, **kw).withColumn("score", F.round("score", 9))
    w = Window.partitionBy(cluster).orderBy(F.desc("score"), F.desc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_terms)


def cluster_terms(df: DataFrame, n_terms: int = 12, **kw) -> DataFrame:
    """(cluster, TopTerms): the best terms joined by ", ". Clusters without terms have no row."""
    cluster = kw.get("cluster", "Cluster")
    best = top_terms(df, n_terms, **kw).groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return best.select(cluster, F.concat_ws(", ", "t.term").alias("TopTerms"))

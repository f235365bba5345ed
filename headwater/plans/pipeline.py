"""The batch run: a raw export in, a folder of tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from headwater.functions.text import embedding_text
from headwater.operators import clusters, dedup, providers, terms, volumes
from headwater.plans.lineage import stage
from headwater.sources.delimited import read_posts
from headwater.sources.sinks import write_table


@dataclass
class Options:
    clusters: int = 6
    sentiment: bool = False
    threshold: float = 0.90
    profile: str = "export"
    format: str = "parquet"


def run(spark: SparkSession, source: str, out: str, options: Options | None = None) -> list[str]:
    """Reads posts, embeds, clusters and describes them; returns the names of the tables written under ``out``."""
    o = options or Options()
    written: list[str] = []

    def save(df, name: str) -> None:  # noqa: ANN001
        write_table(df, f"{out}/{name}", o.format)
        written.append(name)

    posts = read_posts(spark, source, o.profile)
    save(posts, "clean")
    vectors = stage(posts.select("row_id", providers.embedded(embedding_text(F.col("Title"), F.col("Snippet"))).alias("embedding")))
    write_table(vectors, f"{out}/embeddings")
    written.append("embeddings")
    labels = clusters.kmeans(vectors, o.clusters)
    clustered = stage(volumes.attach_clusters(posts, labels))
    save(clustered, "clustered")
    text = terms.ensure_text(clustered)
    save(terms.cluster_terms(text), "cluster_top_terms")
    save(clusters.projection(vectors), "coords")
    if o.sentiment:
        rated = stage(text.withColumn("Sentiment", providers.sentiment(F.col("_text_norm"))))
        save(rated, "clustered_with_sentiment")
        save(providers.sentiment_by_cluster(rated), "sentiment_by_cluster")
    pairs = stage(dedup.similar_vectors(dedup.eligible(posts).select("row_id").join(vectors, "row_id"), "row_id", "embedding", o.threshold))
    kept = stage(dedup.deduplicated(clustered, pairs))
    save(pairs.orderBy(F.desc("similarity"), "i", "j"), "duplicate_pairs")
    save(dedup.duplicate_groups(pairs, dedup.eligible(clustered)).orderBy("DupGroupID", "Index"), "duplicate_groups")
    save(kept, "dedup")
    save(dedup.dedup_summary(clustered, kept), "dedup_summary")
    if volumes.dataset_span(clustered).first()["any_dated"]:
        save(volumes.weekly_counts(volumes.with_week(clustered)), "timeline_by_week_cluster")
    return written


def main(args: list[str] | None = None) -> None:
    import argparse

    p = argparse.ArgumentParser(prog="headwater")
    p.add_argument("--input", required=True)
    p.add_argument("--outdir", default="out")
    p.add_argument("--clusters", type=int, default=6)
    p.add_argument("--do_sentiment", action="store_true")
    p.add_argument("--dedup_threshold", type=float, default=0.90)
    p.add_argument("--format", choices=("parquet", "csv"), default="csv")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("headwater").getOrCreate()
    run(spark, a.input, a.outdir, Options(a.clusters, a.do_sentiment, a.dedup_threshold, "export", a.format))


if __name__ == "__main__":
    main()

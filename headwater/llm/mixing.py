"""Mixing sources to target weights: Pareto order sampling.

Every source is to give target_share of the tokens of all documents. A document is taken a whole number of
times for certain, the whole part of what its source needs; the remaining fraction of the source's tokens comes from an
unequal-probability sample. A document's inclusion probability p is in proportion to its tokens, at most 1, with the
factor at which the expected tokens are the fraction wanted. Documents are ranked by Pareto order, random odds over
inclusion odds, u / (1 - u) : p / (1 - p), u a hash of the id, and the first ones are taken until the size is reached.
A source too small even at its largest number of repeats is taken that often and falls short.

Scale: texts are read once and reduced to (id, source, tokens). The factors come from a histogram of sizes (eight classes
to a power of two) of each target source. The running total along the ranking is found in two steps, over a histogram of the ranks and then within its one bucket that holds the end, so no source,
whatever its size, is sorted in one task. Targets are a table of a few sources and are broadcast by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.tokens import token_count
from headwater.plans.lineage import cut

BUCKETS, SEED, CLASSES = 4096, 20240, 8


def sized_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, source, tokens), cut."""
    return cut(df.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), token_count(F.col(text)).alias("tokens")))


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: tokens there are, tokens wanted, copies per document and whether it falls short."""
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    own = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    plan = wanted.join(own, "source", "left").na.fill(0, ["available", "documents"])
    want = F.coalesce("target_share", F.lit(0.0)) * F.lit(total)
    most = F.coalesce("max_repeats", F.lit(0))
    short = F.col("available") * most < want
    copies = F.when(short, most.cast("double")).when(F.col("available") > 0, want / F.col("available")).otherwise(0.0)
    plan = plan.select("source", "target_share", "max_repeats", "available", "documents", want.alias("wanted"), short.alias("short"), copies.alias("copies"))
    return plan.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole")).withColumn("all_tokens", F.lit(total))


def inclusion_factors(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, factor): the factor by which tokens become inclusion probabilities, min(1, factor * tokens).

    Found by halving over the sums of the size classes, at most a few hundred of each target source; how many documents
    are taken does not hang on it but on the running total of their tokens.
    """
    goals = plan.where("p > 0 and available > 0").select("source", (F.col("p") * F.col("available")).alias("goal"))
    size = F.floor(F.log2(F.col("tokens").cast("double")) * CLASSES)
    sums = sized.where("tokens > 0").join(F.broadcast(goals), "source").groupBy("source", "goal", size.alias("size"))  # one row per target source
    table = sums.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).toPandas()
    rows = []
    for source, g in table.groupby("source"):
        goal, t, mean = float(g["goal"].iloc[0]), g["t"].to_numpy(float), g["t"].to_numpy(float) / g["n"].to_numpy(float)
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if (t * (middle * mean).clip(max=1.0)).sum() < goal else (low, middle)
        rows.append((source, high))
    return sized.sparkSession.createDataFrame(rows, "source string, factor double")


def _uniform(*columns: str) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(SEED)), 11).cast("double") + 0.5) / float(1 << 53)


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: key, source, tokens, copies >= 1; shares: one row per target source with what was reached).

    Documents of null sources or of sources without a target are not mixed, but count in the tokens the shares
    refer to; documents without tokens are in no sample, only in whole copies. Repeated rows are documents of their own (ranked by a row hash of id and tokens, ties together).
    A target named twice counts once with its largest values; null shares and repeats are 0.
    """
    sized = sized_documents(df, key, source, text)
    plan = cut(source_plan(sized, targets))
    factors = inclusion_factors(sized, plan)
    rated = sized.join(plan.select("source", "whole", "p", "copies", "available"), "source").join(F.broadcast(factors), "source", "left")
    u, own = _uniform("id"), F.least(F.lit(1.0), F.col("factor") * F.col("tokens"))
    pareto = F.when(own >= 1, 0.0).when(own > 0, (u / (1 - u)) / (own / (1 - own)))
    rank = pareto / (1 + pareto)  # in (0, 1), in the same order
    rated = cut(rated.select("id", "source", "tokens", "whole", (F.col("p") * F.col("available")).alias("goal"), rank.alias("rank"), F.floor(rank * BUCKETS).alias("bucket")))

    histogram = rated.where("rank is not null").groupBy("source", "bucket").agg(F.sum("tokens").alias("t"), F.first("goal").alias("goal"))
    along = Window.partitionBy("source").orderBy("bucket")
    upto = histogram.withColumn("before", F.sum("t").over(along) - F.col("t"))
    last = upto.where("before < goal").groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("m")).select("source", F.col("m.bucket").alias("edge"), F.col("m.before").alias("before"))
    placed = rated.join(F.broadcast(last), "source", "left")  # one row per target source
    sure = placed.select("id", "source", "tokens", (F.col("whole") + F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0)).alias("copies"), "rank", "bucket", "edge", "before", "goal")
    inner = Window.partitionBy("source").orderBy("rank", "id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = sure.where("bucket = edge").withColumn("sum", F.sum("tokens").over(inner) + F.col("before"))
    # the one that crosses the goal is taken if that comes nearer to it
    taken = at_edge.withColumn("copies", F.col("copies") + F.when(F.col("sum") - F.col("tokens") / 2.0 <= F.col("goal"), 1).otherwise(0))
    rest = sure.where("bucket is null or edge is null or bucket != edge")
    chosen = rest.select("id", "source", "tokens", "copies").unionAll(taken.select("id", "source", "tokens", "copies")).where("copies > 0")
    chosen = cut(chosen.withColumn("copies", F.col("copies").cast("int")))

    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("repeats"), F.count("*").alias("used"))
    shares = plan.join(reached, "source", "left").na.fill(0, ["tokens", "repeats", "used"])
    whole = Window.partitionBy()
    shares = shares.select(
        "source", "target_share", "max_repeats", "available", "documents", "used", "repeats", "tokens", "short",
        F.round(F.col("tokens") / F.greatest(F.col("all_tokens"), F.lit(1)), 6).alias("share_of_all"),
        F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(whole), F.lit(1)), 6).alias("share_of_mix"),
    )
    return chosen.withColumnRenamed("id", key), shares


def short_sources(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(source) of the targets that fall short however often their documents may be repeated."""
    return source_plan(sized_documents(df, key, source, text), targets).where("short").select("source")

"""The core's queries, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.operators import clusters, dedup, kwic, narration, normalize, providers, terms, volumes
from headwater.operators.timestamps import EXACT, normalize_timestamps
from headwater.plans.lineage import cut, spread, stage
from headwater.sources.sinks import peak
from headwater.sources.tables import table

PATTERN = r"\b(?:council|market|agency)\b"


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    posts = spread(table(spark, d, "clean").select("row_id", "Date", "Time", "feed"))
    return normalize_timestamps(posts, table(spark, d, "feeds")).select("row_id", "Date", "utc_us")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    exact = F.coalesce(F.col("Date").rlike(EXACT), F.lit(False))
    return p1_instants(spark, d).where("utc_us is not null").where(~exact).select("row_id", "utc_us")


def posts(spark: SparkSession, d: str) -> DataFrame:
    """The posts in canonical form, dated by when they were ingested, with the cluster of their latest run."""
    clean = table(spark, d, "clean").withColumn("Date", F.col("ingested_at"))
    return volumes.attach_clusters(normalize.canonical(clean), volumes.latest_labels(table(spark, d, "clustered")))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where("Cluster is not null")


def names(df: DataFrame) -> DataFrame:
    """A short name for each cluster; some share one."""
    return df.select("Cluster").distinct().select("Cluster", F.concat(F.lit("Theme "), (F.col("Cluster") % 3).cast("string")).alias("Narrative"))


def canonical_posts(spark: SparkSession, d: str) -> DataFrame:
    return normalize.with_text(posts(spark, d)).select("row_id", "Title", "Snippet", "Date", "URL", "author", "display_name", *normalize.ENGAGEMENT)


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return normalize.first_of_equals(normalize.with_text(posts(spark, d)).select("row_id", "Title", "Snippet", "URL"), "row_id")


def renumbered_posts(spark: SparkSession, d: str) -> DataFrame:
    return normalize.renumbered(posts(spark, d).select(F.col("row_id").alias("source_id")), "source_id")


def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return volumes.cluster_counts(clustered(spark, d))


def narrative_volumes(spark: SparkSession, d: str) -> DataFrame:
    df = clustered(spark, d)
    return volumes.narrative_volumes(df, names(df))


def largest_narrative(spark: SparkSession, d: str) -> DataFrame:
    return peak(narrative_volumes(spark, d), "Volume", "Cluster")


def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return volumes.share_of_total(clustered(spark, d), "Cluster")


def dataset_span(spark: SparkSession, d: str) -> DataFrame:
    return volumes.dataset_span(posts(spark, d))


def timeline_adaptive(spark: SparkSession, d: str) -> DataFrame:
    df = clustered(spark, d)
    return volumes.timeline(df, names=names(df))


def _span(spark: SparkSession, d: str, first: str, last: str) -> DataFrame:
    return volumes.timeline(clustered(spark, d).where((F.col("Date") >= first) & (F.col("Date") < last)))


def timeline_days(spark: SparkSession, d: str) -> DataFrame:
    return _span(spark, d, "2025-03-01", "2025-03-06")


def timeline_three_days(spark: SparkSession, d: str) -> DataFrame:
    return _span(spark, d, "2025-03-01", "2025-03-20")


def timeline_weeks(spark: SparkSession, d: str) -> DataFrame:
    return _span(spark, d, "2025-03-01", "2025-05-01")


def timeline_weekly(spark: SparkSession, d: str) -> DataFrame:
    return volumes.weekly_counts(volumes.with_week(clustered(spark, d)))


def top_posters_volume(spark: SparkSession, d: str) -> DataFrame:
    return volumes.top_posters(posts(spark, d), "Volume")


def top_posters_engagement(spark: SparkSession, d: str) -> DataFrame:
    return volumes.top_posters(posts(spark, d), "Engagement")


def engagement_total(spark: SparkSession, d: str) -> DataFrame:
    return volumes.engagement_total(clustered(spark, d))


def top_authors_by_theme(spark: SparkSession, d: str) -> DataFrame:
    df = clustered(spark, d)
    return volumes.authors_by_theme(df, names(df))


def author_theme_table(spark: SparkSession, d: str) -> DataFrame:
    return volumes.author_theme_table(clustered(spark, d), list(range(8)))


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return volumes.fingerprint(table(spark, d, "clean"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return terms.ensure_text(table(spark, d, "clean").select("row_id", "Title", "Snippet"))


def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    s, t = F.col("Snippet"), F.col("Title")
    return table(spark, d, "clean").select(
        "row_id", X.first_sentence(s).alias("first"), X.lead_sentence(s).alias("lead"), X.candidate_line(t, s).alias("line")
    )


def display_labels(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("row_id", X.display_label(F.col("author"), F.col("display_name")).alias("display_label"))


def hover_texts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "clean")
    return df.select("row_id", X.hover_text(F.col("Title"), F.col("Snippet"), F.col("ingested_at"), F.col("URL")).alias("hover"))


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("row_id", X.embedding_text(F.col("Title"), F.col("Snippet")).alias("text"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    words = normalize_text(spark, d).select(F.explode(X.context_tokens(F.col("_text_norm"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def _instant(micros: str) -> Column:
    """Microseconds since 1970 as a timestamp without zone, in UTC whatever the session's zone."""
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({micros} as decimal(24, 6)) / 1000000)")


def own_dated_posts(spark: SparkSession, d: str) -> DataFrame:
    """The posts in canonical form, dated by their own Date and Time in UTC, with the cluster of their latest run.

    Where these fix no instant (no time of day, no known zone) but a day, Date is as written, midnight without a time
    of day; where they fix no day, it is null.
    """
    feeds = table(spark, d, "feeds")
    dated = normalize_timestamps(spread(table(spark, d, "clean")), feeds, out="__hw_utc")
    rest = dated.withColumns({"__hw_date": F.when(F.col("__hw_utc").isNull(), F.col("Date")), "__hw_time": F.lit("00:00")})
    days = normalize_timestamps(rest, feeds.withColumn("tz", F.lit("UTC")), "__hw_date", "__hw_time", out="__hw_day")
    own = days.withColumn("__hw_us", F.coalesce("__hw_utc", "__hw_day")).withColumn("Date", _instant("__hw_us"))
    canonical = normalize.canonical(own.drop("__hw_utc", "__hw_date", "__hw_time", "__hw_day", "__hw_us"))
    return volumes.attach_clusters(canonical, volumes.latest_labels(table(spark, d, "clustered")))


def own_canonical_posts(spark: SparkSession, d: str) -> DataFrame:
    return normalize.with_text(own_dated_posts(spark, d)).select("row_id", "Title", "Snippet", "Date", "URL", "author", "display_name", *normalize.ENGAGEMENT)


def own_dataset_span(spark: SparkSession, d: str) -> DataFrame:
    return volumes.dataset_span(own_dated_posts(spark, d))


def _own_clustered(spark: SparkSession, d: str) -> DataFrame:
    return cut(own_dated_posts(spark, d).where("Cluster is not null").select("Cluster", "Date"))  # read twice, made once


def own_timeline_adaptive(spark: SparkSession, d: str) -> DataFrame:
    df = _own_clustered(spark, d)
    return volumes.timeline(df, names=names(df))


def _own_span(spark: SparkSession, d: str, first: str, last: str) -> DataFrame:
    return volumes.timeline(_own_clustered(spark, d).where((F.col("Date") >= first) & (F.col("Date") < last)))


def own_timeline_days(spark: SparkSession, d: str) -> DataFrame:
    return _own_span(spark, d, "2025-03-01", "2025-03-06")


def own_timeline_three_days(spark: SparkSession, d: str) -> DataFrame:
    return _own_span(spark, d, "2025-03-01", "2025-03-20")


def own_timeline_weeks(spark: SparkSession, d: str) -> DataFrame:
    return _own_span(spark, d, "2025-03-01", "2025-05-01")


def own_timeline_weekly(spark: SparkSession, d: str) -> DataFrame:
    return volumes.weekly_counts(volumes.with_week(own_dated_posts(spark, d).where("Cluster is not null")))


def own_takeaways(spark: SparkSession, d: str) -> DataFrame:
    return _takeaways(own_dated_posts(spark, d).where("Cluster is not null"))


def normalized_posts(spark: SparkSession, d: str) -> DataFrame:
    """clean as a raw table of the ``alias`` profile: dated by the reference's lenient rule, null where it finds none."""
    return normalize.normalize_posts(table(spark, d, "clean"), keep=["row_id"])


def normalized_exports(spark: SparkSession, d: str) -> DataFrame:
    """As normalized_posts, by the ``export`` profile."""
    return normalize.normalize_posts(table(spark, d, "clean"), "export", keep=["row_id"])


def _normed(spark: SparkSession, d: str) -> DataFrame:
    return terms.ensure_text(clustered(spark, d)).select("row_id", "Cluster", "Title", "_text_norm")


def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.top_terms(_normed(spark, d)).select("Cluster", "rank", "term", F.round("score", 7).alias("score"))


def cluster_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.cluster_terms(_normed(spark, d))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return kwic.kwic_search(terms.ensure_text(clustered(spark, d)), PATTERN, max_rows=None)


def kwic_search(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


def kwic_counts(spark: SparkSession, d: str) -> DataFrame:
    return kwic.kwic_counts(_matches(spark, d))


def kwic_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return kwic.kwic_cooccurrence(cut(_matches(spark, d)))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("Cluster"))


def central_posts(spark: SparkSession, d: str) -> DataFrame:
    return clusters.central(_vectors(spark, d)).select("Cluster", "rank", "row_id", F.round("score", 4).alias("score"))


def _similar(spark: SparkSession, d: str) -> DataFrame:
    return cut(dedup.similar_vectors(_vectors(spark, d), "row_id", "embedding", 0.4))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).select(F.round("similarity", 4).alias("similarity"), "i", "j")


def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(_similar(spark, d), _vectors(spark, d)).select("DupGroupID", "Index", "Cluster")


def _deduplicated(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("Title"), F.col("text").alias("Snippet"))
    return dedup.deduplicated(_vectors(spark, d).join(texts, "row_id", "left"), _similar(spark, d))


def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d).select("row_id", "Cluster")


def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_summary(_vectors(spark, d), _deduplicated(spark, d))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(_vectors(spark, d).select("row_id", "embedding"), 6)


def projection(spark: SparkSession, d: str) -> DataFrame:
    return clusters.projection(_vectors(spark, d))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    df = spread(clustered(spark, d).select("row_id", "Title", "Snippet", "Cluster"))
    return stage(df.withColumn("embedding", providers.embedded(X.embedding_text(F.col("Title"), F.col("Snippet")))))  # embedded once, read several times


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(spark, d).select("row_id", "embedding")


def _post_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All posts of clean, with or without a cluster, and the vectors of their texts."""
    df = spread(posts(spark, d).select("row_id", "Title", "Snippet", "URL", "Cluster"))
    return df.withColumn("embedding", providers.embedded(X.embedding_text(F.col("Title"), F.col("Snippet"))))


def _similar_posts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.similar_vectors(dedup.eligible(_post_vectors(spark, d)), "row_id", "embedding")


def near_dup_posts(spark: SparkSession, d: str) -> DataFrame:
    return _similar_posts(spark, d)


def dup_post_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(cut(_similar_posts(spark, d)), dedup.eligible(posts(spark, d)))


def deduplicated_posts(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d).select("row_id", "Cluster", "Title", "Snippet")
    return dedup.deduplicated(rows, cut(_similar_posts(spark, d)))


def post_dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    """Posts without a cluster are counted under null."""
    return dedup.dedup_summary(posts(spark, d), deduplicated_posts(spark, d))


def central_of_posts(spark: SparkSession, d: str) -> DataFrame:
    return clusters.central(_embedded(spark, d))


def kmeans_posts(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(_post_vectors(spark, d).select("row_id", "embedding"), 6)


def projected_posts(spark: SparkSession, d: str) -> DataFrame:
    return clusters.projection(_post_vectors(spark, d))


def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    return clusters.summarize(_embedded(spark, d))


def narratives(spark: SparkSession, d: str) -> DataFrame:
    df = _embedded(spark, d)
    texts = clusters.representative_texts(df, clusters.central(df))
    return narration.narrate(texts, lambda prompt: prompt.rsplit("\n\n", 1)[-1])


def takeaways(spark: SparkSession, d: str) -> DataFrame:
    """Takeaways of an offline narrator that repeats the first line of every section of the prompt."""
    return _takeaways(posts(spark, d).where("Cluster is not null"))


def _takeaways(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    named = names(df)
    told = named.withColumn("summary", F.concat(F.lit("about "), "Narrative"))
    by_volume = volumes.top_posters(df)
    authors = df.join(F.broadcast(by_volume.select("author").distinct()), "author")  # ten rows: the authors a prompt can hold
    counts = authors.groupBy("author", "Cluster").agg(F.count("*").alias("PostCount")).join(named, "Cluster", "left")
    prompt = narration.takeaways_prompt(
        told, volumes.narrative_volumes(df, named), by_volume, volumes.top_posters(df, "Engagement"), counts, volumes.timeline(df, names=named)
    )
    reply = narration.ask(lambda p: "\n".join("- " + section.split("\n")[1] for section in p.split("\n\n")[1:]), prompt)
    bullets = spark.createDataFrame([(reply,)], "reply string").select(F.explode(narration.parse_bullets(F.col("reply"))).alias("takeaway"))
    return bullets


def sentiment_scores(spark: SparkSession, d: str) -> DataFrame:
    return spread(_normed(spark, d)).select("row_id", "Cluster", providers.sentiment(F.col("_text_norm")).alias("Sentiment"))


def sentiment_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return providers.sentiment_by_cluster(sentiment_scores(spark, d))


def likes_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    return providers.sentiment_by_cluster(clustered(spark, d).drop("Likes").join(table(spark, d, "clean").select("row_id", "Likes"), "row_id"), score="Likes")


def entities(spark: SparkSession, d: str) -> DataFrame:
    return providers.extract_entities(_normed(spark, d)).groupBy("Cluster", "Entity", "Label").agg(F.count("*").alias("Count"))


def top_entities(spark: SparkSession, d: str) -> DataFrame:
    by_feed = clustered(spark, d).select("Cluster", F.col("feed").alias("Entity"), F.lit("ORG").alias("Label"))
    return providers.top_entities(by_feed, "ORG")[1]


def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    counts = volumes.cluster_counts(clustered(spark, d))
    return narration.prompt_lines(counts, F.concat_ws(": ", F.col("Cluster").cast("string"), F.col("Count").cast("string")), -F.col("Count"), "Cluster")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p1_found, p1_instants, canonical_posts, exact_dedup, renumbered_posts, cluster_counts, narrative_volumes, largest_narrative, share_of_total,
        dataset_span, timeline_adaptive, timeline_days, timeline_three_days, timeline_weeks, timeline_weekly, top_posters_volume,
        top_posters_engagement, engagement_total, top_authors_by_theme, author_theme_table, fingerprint, normalize_text, first_sentences,
        display_labels, hover_texts, embedding_texts, token_counts, tfidf_terms, cluster_terms, kwic_search, kwic_counts, kwic_cooccurrence,
        central_posts, near_dup_pairs, dup_groups, deduplicated, dedup_summary, kmeans_clusters, projection, embeddings,
        own_canonical_posts, own_dataset_span, own_timeline_adaptive, own_timeline_days, own_timeline_three_days, own_timeline_weeks,
        own_timeline_weekly, own_takeaways, normalized_posts, normalized_exports,
        near_dup_posts, dup_post_groups, deduplicated_posts, post_dedup_summary, central_of_posts, kmeans_posts, projected_posts, extractive_summary,
        narratives, takeaways, sentiment_scores, sentiment_by_cluster, likes_by_cluster, entities, top_entities, prompt_lines,
    )
    return {f.__name__: f for f in named}


def _strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{X.WHITE}+|{X.WHITE}+$', '', 'g')"


def _norm(title: str, snippet: str) -> str:
    s = f"coalesce({title}, '') || ' ' || coalesce({snippet}, '')"
    for p in ("<[^>]+>", r"&[\p{L}\p{N}_]+;", f"http{X.NOT_WHITE}+", X.NOT_WORD, " +"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    return f"trim({s})"


AMOUNTS = ", ".join(f"coalesce({c}, 0) as {c}" for c in normalize.ENGAGEMENT)
ENGAGED = " + ".join(normalize.ENGAGEMENT)
POSTS = f"""labels as (select row_id, Cluster from (select *, row_number() over (partition by row_id order by clustered_at desc nulls last, Cluster desc) as rn
  from clustered where Cluster is not null) where rn = 1),
posts as (select row_id, {_strip("Title")} as Title, {_strip("Snippet")} as Snippet, ingested_at as Date, {_strip("URL")} as URL, {_strip("author")} as author,
  {_strip("display_name")} as display_name, {AMOUNTS}, feed, Cluster from clean left join labels using (row_id)),
known as (select * from posts where Cluster is not null),
names as (select distinct Cluster, 'Theme ' || (Cluster % 3) as Narrative from known)"""
LABEL = "substring(case when display_name <> '' then display_name || ' (' || author || ')' else author end, 1, 40)"
STOPS = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))
PARTS = f"list_transform(string_split(regexp_replace(coalesce(Snippet, ''), '([.!?]){X.WHITE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')})"
DOTTED = "regexp_replace({}, '\\.+$', '') || '.'"


def _timeline(first: str | None, last: str | None, label: str) -> str:
    inside = f"where Date >= timestamp '{first}' and Date < timestamp '{last}'" if first else ""
    return f"""with {POSTS}, span as (select * from known {inside}), o as (select cast(min(Date) as date) as origin from span)
select Cluster, cast({label} as timestamp) as Date, count(*) as Volume from span, o where Date is not null group by all"""


SCORES = f"""{POSTS},
docs as (select Cluster, row_id, list_filter(string_split_regex(lower({_norm("Title", "Snippet")}), '{X.NOT_WORD}'), lambda t: len(t) >= 2 and t not in ({STOPS})) as one from known),
grams as (select Cluster, row_id, unnest(list_concat(one, case when len(one) > 1 then list_transform(range(1, len(one)), lambda i: one[i] || ' ' || one[i + 1]) else [] end)) as term from docs),
tf as (select Cluster, row_id, term, count(*) as tf from grams group by all),
sizes as (select Cluster, count(*) as n from known group by all),
kept as (select Cluster, term, n, ln((1.0 + n) / (1.0 + count(*))) + 1.0 as idf from tf join sizes using (Cluster) group by Cluster, term, n
  having count(*) >= case when n < 5 then 1 else 2 end and count(*) <= 0.8 * n),
w as (select Cluster, row_id, term, n, tf * idf as w from tf join kept using (Cluster, term)),
v as (select Cluster, term, n, w / sqrt(sum(w * w) over (partition by Cluster, row_id)) as w from w),
s as (select Cluster, term, round(sum(w) / any_value(n), 9) as score from v group by Cluster, term),
ranked as (select *, row_number() over (partition by Cluster order by score desc, term desc) as rank from s)"""

SIMILAR = """v as (select vec_id as id, label, embedding::double[] as e from embeddings),
u as (select id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v),
pairs as (select a.id as i, b.id as j, list_dot_product(a.e, b.e) as similarity from u a join u b on a.id < b.id where list_dot_product(a.e, b.e) >= 0.4),
both_ways as (select i as a, j as b from pairs union select j, i from pairs),
reach as (select a as node, a as other from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
comp as (select node, min(other) as component from reach group by node),
kept as (select vec_id, label from embeddings left join comp on vec_id = node left join documents on vec_id = doc_id
  qualify component is null or row_number() over (partition by component order by length(concat_ws(' ', coalesce(source, ''), coalesce(text, ''))) desc, vec_id) = 1)"""


def oracle_sql() -> dict[str, str]:
    lead = f"(case when len(list_filter({PARTS}, lambda s: len(s) >= 25)) > 0 then {DOTTED.format(f'substring(list_filter({PARTS}, lambda s: len(s) >= 25)[1], 1, 180)')} when len(list_filter({PARTS}, lambda s: len(s) > 0)) > 0 then {DOTTED.format(f'substring(list_filter({PARTS}, lambda s: len(s) > 0)[1], 1, 180)')} else '' end)"
    title, snippet = _strip("Title"), _strip("Snippet")
    rest = f"substring(case when {snippet} <> '' then {snippet} when {title} <> '' then {title} else 'No clear summary' end, 1, 120)"
    whole = _strip(f"substring({snippet}, 1, 180)")
    return {
        "canonical_posts": f"with {POSTS} select row_id, Title, Snippet, Date, URL, author, display_name, {', '.join(normalize.ENGAGEMENT)} from posts where Title <> '' or Snippet <> ''",
        "exact_dedup": f"with {POSTS} select row_id, Title, Snippet, URL from posts where Title <> '' or Snippet <> '' qualify row_number() over (partition by Title, Snippet order by row_id) = 1",
        "renumbered_posts": "select row_id as source_id, row_number() over (order by row_id) - 1 as row_id from clean",
        "cluster_counts": f'with {POSTS} select Cluster, count(*) as "Count" from known group by Cluster',
        "narrative_volumes": f"with {POSTS} select Cluster, count(*) as Volume, any_value(Narrative) as Narrative from known join names using (Cluster) group by Cluster",
        "largest_narrative": f"with {POSTS} select Cluster, count(*) as Volume, any_value(Narrative) as Narrative from known join names using (Cluster) group by Cluster order by Volume desc, Cluster limit 1",
        "share_of_total": f"with {POSTS} select Cluster, count(*) as Posts, round(100.0 * count(*) / sum(count(*)) over (), 2) as Share_pct from known group by Cluster",
        "dataset_span": f"with {POSTS} select min(Date) as first, max(Date) as last, cast(floor((epoch_us(max(Date)) - epoch_us(min(Date))) / 86400000000) as integer) as days, count(Date) as dated, count(Date) > 0 as any_dated from posts",
        "timeline_adaptive": f"with {POSTS} select Cluster, cast(last_day(Date) as timestamp) as Date, count(*) as Volume, any_value(Narrative) as Narrative from known join names using (Cluster) where Date is not null group by Cluster, last_day(Date)",
        "timeline_days": _timeline("2025-03-01", "2025-03-06", "cast(Date as date)"),
        "timeline_three_days": _timeline("2025-03-01", "2025-03-20", "origin + to_days(cast(3 * floor((cast(Date as date) - origin) / 3) as integer))"),
        "timeline_weeks": _timeline("2025-03-01", "2025-05-01", "date_trunc('week', Date) + interval 6 days"),
        "timeline_weekly": f'with {POSTS} select cast(date_trunc(\'week\', Date) as timestamp) as "Week", Cluster, count(*) as "Count" from known where Date is not null group by all',
        "top_posters_volume": f"with {POSTS} select author, {LABEL} as display_label, count(*) as Volume from posts group by all order by Volume desc, author, display_label limit 10",
        "top_posters_engagement": f"with {POSTS} select author, {LABEL} as display_label, round(sum({ENGAGED}), 6) as Engagement from posts group by all order by Engagement desc, author, display_label limit 10",
        "engagement_total": f"with {POSTS} select Cluster, round(sum({ENGAGED}), 6) as Engagement from known group by Cluster",
        "top_authors_by_theme": f"with {POSTS}, c as (select Cluster, author, count(*) as PostCount from known group by all) select Cluster, author, PostCount, Narrative from c join names using (Cluster) qualify row_number() over (partition by Narrative order by PostCount desc, Cluster, author) <= 5",
        "author_theme_table": f"with {POSTS} select author, {', '.join(f'count(*) filter (Cluster = {k}) as theme_{k}' for k in range(8))} from known group by author",
        "normalize_text": f"select row_id, Title, Snippet, {_norm('Title', 'Snippet')} as _text_norm from clean",
        "first_sentences": f"""select row_id, case when len(list_filter({PARTS}, lambda s: len(s) >= 25)) > 0 then substring(list_filter({PARTS}, lambda s: len(s) >= 25)[1], 1, 180) else {whole} end as first,
  {lead} as lead, case when len({lead}) >= 25 then {lead} when len({title}) >= 30 then {DOTTED.format(title)} else {DOTTED.format(rest)} end as line from clean""",
        "display_labels": f"with {POSTS} select row_id, {LABEL} as display_label from posts",
        "hover_texts": """select row_id, concat_ws('<br>', 'Title: ' || coalesce(Title, ''), 'Date: ' || strftime(ingested_at, '%Y-%m-%d %H:%M:%S'), 'URL: ' || URL,
  'Snippet: ' || case when length(coalesce(Snippet, '')) > 160 then substring(Snippet, 1, 160) || '…' else coalesce(Snippet, '') end) as hover from clean""",
        "embedding_texts": f"with {POSTS} select row_id, Title || '. ' || Snippet as text from posts",
        "token_counts": f"select token, count(*) as n from (select unnest(string_split_regex(lower({_norm('Title', 'Snippet')}), '{X.NOT_WORD}')) as token from clean) where regexp_full_match(token, '[a-z0-9]{{3,}}') and token not in ({STOPS}) group by token",
        "tfidf_terms": f"with {SCORES} select Cluster, cast(rank as integer) as rank, term, round(score, 7) as score from ranked where rank <= 12",
        "cluster_terms": f"with {SCORES} select Cluster, string_agg(term, ', ' order by rank) as TopTerms from ranked where rank <= 12 group by Cluster",
        "kwic_counts": f"""with {POSTS}, w as (select Cluster, unnest(string_split_regex(lower({_norm('Title', 'Snippet')}), '{X.NOT_WORD}')) as word from known)
select Cluster, count(*) as KWIC_Matches from w where word in ('council', 'market', 'agency') group by Cluster""",
        "central_posts": """with m as (select label, list(x order by pos) as centroid from (select label, pos, avg(x) as x from (select label, unnest(embedding::double[]) as x, unnest(range(1, len(embedding) + 1)) as pos from embeddings) group by label, pos) group by label),
s as (select label as Cluster, vec_id as row_id, round(list_dot_product(centroid, embedding::double[]), 6) as score from embeddings join m using (label))
select Cluster, cast(row_number() over (partition by Cluster order by score desc, row_id desc) as integer) as rank, row_id, round(score, 4) as score from s qualify rank <= 5""",
        "near_dup_pairs": f"with recursive {SIMILAR} select round(similarity, 4) as similarity, i, j from pairs",
        "dup_groups": f"""with recursive {SIMILAR}, starts as (select vec_id as component, row_number() over (order by vec_id) - 1 as g from embeddings left join comp on vec_id = node where component is null or component = node)
select cast(g as integer) as DupGroupID, node as "Index", label as Cluster from comp join starts using (component) join embeddings on node = vec_id""",
        "deduplicated": f"with recursive {SIMILAR} select vec_id as row_id, label as Cluster from kept",
        "dedup_summary": f"""with recursive {SIMILAR}, b as (select label, count(*) as n from embeddings group by label), a as (select label, count(*) as n from kept group by label)
select b.label as Cluster, b.n as Before, coalesce(a.n, 0) as After, b.n - coalesce(a.n, 0) as Removed, round(100.0 * (b.n - coalesce(a.n, 0)) / b.n, 2) as Pct_Removed from b left join a using (label)""",
        "likes_by_cluster": f"with {POSTS} select Cluster, count(clean.Likes) as count, round(avg(clean.Likes), 6) as mean, round(median(clean.Likes), 6) as median, min(clean.Likes) as min, max(clean.Likes) as max from known join clean using (row_id) group by Cluster",
        "top_entities": f"with {POSTS}, c as (select Cluster, feed as Entity, count(*) as Count from known group by all) select * from c qualify row_number() over (partition by Cluster order by Count desc, Entity) <= 15",
        "prompt_lines": f"with {POSTS}, c as (select Cluster, count(*) as n from known group by Cluster) select string_agg(Cluster || ': ' || n, chr(10) order by n desc, Cluster) as lines from c",
    }

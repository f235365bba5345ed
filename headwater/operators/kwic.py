"""Keyword in context, and what occurs with it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.text import context_tokens
from headwater.operators.terms import ensure_text
from headwater.plans.lineage import spread


def kwic_search(
    df: DataFrame, pattern: str, window: int = 50, case: bool = False, clusters: int | list | None = None, key: str = "row_id",
    cluster: str = "Cluster", title: str = "Title", snippet: str = "Snippet", extra: tuple[str, ...] = (), max_rows: int | None = 2000,
) -> DataFrame:
    """(row_id, match_no, Cluster, Title, Left, Match, Right, ...) of every match of a Python expression.

    ``clusters`` keeps one or several clusters (filtered before any Python runs); ``max_rows`` keeps the first
    matches in the order of rows and matches, None keeps all.
    """
    if clusters is not None:
        wanted = [int(clusters)] if not isinstance(clusters, (list, tuple, set)) else [int(c) for c in clusters]
        df = df.where(F.col(cluster).isin(wanted))
    about = [c for c in dict.fromkeys((key, cluster, title, *extra))]
    found = ensure_text(df, title, snippet).select(*about, F.col("_text_norm").alias("__hw_text"))
    out_columns = [*dict.fromkeys((key, "match_no", cluster, title, "Left", "Match", "Right", *extra))]
    kinds = {c: df.schema[c].dataType.simpleString() for c in about} | {"match_no": "int", "Left": "string", "Match": "string", "Right": "string"}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = re.compile(pattern, 0 if case else re.IGNORECASE)
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b["__hw_text"]):
                for k, m in enumerate(search.finditer(text or "")):
                    a, e = m.span()
                    at.append(i)
                    rows.append((k, text[max(0, a - window) : a], m.group(), text[e : e + window]))
            matches = pd.DataFrame(rows, columns=["match_no", "Left", "Match", "Right"])
            yield pd.concat([b[about].iloc[at].reset_index(drop=True), matches], axis=1)[out_columns]

    out = spread(found).mapInPandas(scan, ", ".join(f"`{c}` {kinds[c]}" for c in out_columns))
    return out if max_rows is None else out.orderBy(key, "match_no").limit(max_rows)


def kwic_counts(matches: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return matches.groupBy(cluster).agg(F.count("*").alias("KWIC_Matches"))


def kwic_cooccurrence(matches: DataFrame, top_n: int = 20, cluster: str = "Cluster", key: str = "row_id") -> DataFrame:
    """(Cluster, Term, Count, KWIC_Matches_in_Cluster): the words around the matches, without the matched ones.

    Equal counts go by first occurrence (row, match, place).
    """
    around = F.filter(context_tokens(F.concat_ws(" ", "Left", "Right")), lambda t: ~F.array_contains(context_tokens(F.col("Match")), t))
    words = matches.select(cluster, key, "match_no", F.posexplode(around).alias("pos", "Term"))
    counts = words.groupBy(cluster, "Term").agg(F.count("*").alias("Count"), F.min(F.struct(key, "match_no", "pos")).alias("first"))
    w = Window.partitionBy(cluster).orderBy(F.desc("Count"), "first")
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    per_cluster = kwic_counts(matches, cluster).withColumnRenamed("KWIC_Matches", "KWIC_Matches_in_Cluster")
    return best.join(per_cluster, cluster).select(cluster, "Term", "Count", "KWIC_Matches_in_Cluster")

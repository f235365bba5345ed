"""Narratives and takeaways by a language model, or without one from the extractive summaries.

Prompts are built and replies parsed on tables of a few rows (one per theme); the narrator is a callable on a
prompt, called on the driver, never on executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.text import stripped

NO_BULLETS = "- No significant trends identified."  # fixed value: what stands for a reply without bullets


class TooManyRequests(Exception):
    """The narrator asks to be called again later."""


def summary_prompt(texts: Column) -> Column:
    head = (
        "These posts treat one theme. Reply with exactly three parts:\n"
        "Summary: one or two sentences of your own, under 50 words.\n"
        "Detailed Label: 10 to 20 words.\nShort Label: 2 to 4 specific words.\n\n"
    )
    return F.concat(F.lit(head), F.concat_ws("\n\n", texts))


def parse_summary(df: DataFrame, reply: str = "reply", cluster: str = "Cluster") -> DataFrame:
    """``df`` with summary, detailed and short; without the marks of the two labels the first 200 characters and made-up labels."""
    r = F.coalesce(reply, F.lit(""))
    after = lambda mark: F.split(r, mark, 2)
    marked = r.contains("Detailed Label:") & r.contains("Short Label:")
    part = lambda a, b: stripped(F.split(F.get(after(a), F.lit(1)), b, 2)[0])
    number = F.col(cluster).cast("string")
    return df.withColumns(
        {
            "summary": F.when(marked, stripped(F.replace(F.split(r, "Detailed Label:", 2)[0], F.lit("Summary:"), F.lit("")))).otherwise(F.substring(r, 1, 200)),
            "detailed": F.when(marked, part("Detailed Label:", "Short Label:")).otherwise(F.concat(F.lit("Narrative "), number)),
            "short": F.when(marked, stripped(F.get(after("Short Label:"), F.lit(1)))).otherwise(F.concat(F.lit("Cluster "), number)),
        }
    )


def parse_bullets(reply: Column) -> Column:
    """The lines that begin with a dash; without any, one fixed line."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), stripped), lambda x: x.startswith("-"))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(NO_BULLETS)))


def prompt_lines(df: DataFrame, line: Column, *order: Column | str) -> DataFrame:
    """(lines): one string of a line per row, in order; an empty table gives "(none)". For tables of a few rows."""
    rows = df.select(F.struct(*(F.col(o) if isinstance(o, str) else o for o in order)).alias("o"), line.alias("l"))
    gathered = rows.agg(F.sort_array(F.collect_list(F.struct("o", "l"))).alias("r"))
    return gathered.select(F.when(F.size("r") > 0, F.concat_ws("\n", "r.l")).otherwise("(none)").alias("lines"))


def numbered_narratives(narratives: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """``narratives`` (one row per theme) with ``number``, from 1 in the order of the clusters."""
    return narratives.withColumn("number", F.row_number().over(Window.orderBy(cluster)))


def takeaways_prompt(narratives: DataFrame, volumes: DataFrame, by_volume: DataFrame, by_engagement: DataFrame, author_themes: DataFrame, timeline: DataFrame) -> str:
    """The prompt from the sections' tables (a few rows each), in a fixed order.

    Themes are numbered from 1; ``author_themes`` (author, Narrative, PostCount) gives each of its authors one line
    with the themes they post in, so the caller decides how many authors a prompt can hold.
    """
    say = lambda *cs: F.concat(*(c if not isinstance(c, str) else F.lit(c) for c in cs))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "Narrative" else F.coalesce("Narrative", F.concat(F.lit("Cluster "), F.col("Cluster").cast("string")))
    told = numbered_narratives(narratives)
    known = author_themes.where("PostCount > 0").groupBy("author").agg(
        F.sum("PostCount").alias("all"), F.sort_array(F.collect_list(F.struct((-F.col("PostCount")).alias("o"), "Narrative", say(text("Narrative"), ": ", text("PostCount")).alias("l")))).alias("t")
    )
    sections = {
        "Narratives": prompt_lines(told, say("Narrative ", text("number"), " (", text("Narrative") if "Narrative" in told.columns else say("Cluster ", text("Cluster")), "): ", text("summary")), "number"),
        "Volumes": prompt_lines(volumes, say(text("Narrative"), ": ", text("Volume"), " posts"), -F.col("Volume"), "Cluster"),
        "Top posters by volume": prompt_lines(by_volume, say(text("display_label"), ": ", text("Volume"), " posts"), -F.col("Volume"), "author"),
        "Top posters by engagement": prompt_lines(by_engagement, say(text("display_label"), ": ", text("Engagement"), " engagement"), -F.col("Engagement"), "author"),
        "Authors by theme": prompt_lines(known, say(text("author"), ": ", F.concat_ws(", ", "t.l")), -F.col("all"), "author"),
        "Timeline": prompt_lines(timeline, say(text("Narrative"), ": ", text("Volume"), " posts on ", F.date_format("Date", "yyyy-MM-dd")), "Date", "Cluster"),
    }
    body = "\n\n".join(f"{name}:\n{df.first()['lines']}" for name, df in sections.items())
    return "Give 3 to 5 takeaways, each a line beginning with a dash and under 50 words.\n\n" + body


def ask(narrator: Callable[[str], str], prompt: str, attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> str:
    """The reply; waits 1, 2, 4 seconds when told to come later, any other failure becomes an error text."""
    for k in range(attempts):
        try:
            return narrator(prompt)
        except TooManyRequests as e:
            if k + 1 == attempts:
                return f"Error: {e}"
            wait(2.0**k)
        except Exception as e:  # noqa: BLE001 - a provider may raise anything
            return f"Error: {e}"
    return "Error: no attempt"


def narrate(texts: DataFrame, narrator: Callable[[str], str], cluster: str = "Cluster") -> DataFrame:
    """(cluster, reply, summary, detailed, short) of a table (cluster, texts) with one row per theme."""
    spark = texts.sparkSession
    prompts = texts.select(cluster, summary_prompt(F.col("texts")).alias("prompt")).orderBy(cluster).collect()
    replies = [(r[cluster], ask(narrator, r.prompt)) for r in prompts]
    kind = texts.schema[cluster].dataType.simpleString()
    return parse_summary(spark.createDataFrame(replies, f"{cluster} {kind}, reply string"), cluster=cluster)

"""The canonical post and the header names it is read from."""

from __future__ import annotations

from pyspark.sql import types as T

ENGAGEMENT = ["Likes", "Retweets", "Replies", "Comments", "Shares", "Reactions"]
TEXT_FIELDS = ["Title", "Snippet", "URL", "author", "display_name"]

POST_SCHEMA = T.StructType(
    [
        T.StructField("Title", T.StringType(), False),
        T.StructField("Snippet", T.StringType(), False),
        T.StructField("Date", T.TimestampType()),
        T.StructField("URL", T.StringType(), False),
        T.StructField("author", T.StringType(), False),
        T.StructField("display_name", T.StringType(), False),
        *(T.StructField(c, T.DoubleType(), False) for c in ENGAGEMENT),
    ]
)

# fixed values: accepted headers in order of preference
ALIASES = {
    "title": ["title", "headline", "headlines", "inputname", "keywords"],
    "snippet": ["snippet", "summary", "description", "dek", "selftext", "selftext_html", "body", "text", "openingtext", "hitsentence"],
    "date": ["date", "published", "pubdate", "time", "created", "created_iso", "created_utc", "alternatedateformat"],
    "url": ["url", "link", "permalink", "parenturl"],
    "author": ["author", "influencer"],
    "display_name": ["twitter screen name", "screen_name", "display_name"],
    "Likes": ["likes"],
    "Retweets": ["retweets", "reposts"],
    "Replies": ["replies"],
    "Comments": ["comments"],
    "Shares": ["shares"],
    "Reactions": ["reactions"],
}
EXPORT_TITLE = ["headline", "hitsentence", "openingtext", "inputname", "keywords"]
EXPORT_SNIPPET = ["openingtext", "hitsentence", "headline"]
# fixed values: what counts as missing in a raw file
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def header_key(name: str) -> str:
    """A header without case, white space and underscores."""
    return "".join(name.lower().split()).replace("_", "")


def header_map(columns: list[str]) -> dict[str, str]:
    """Header key to column; of colliding columns the last one wins."""
    return {header_key(c): c for c in columns}


def picked(columns: list[str], aliases: list[str]) -> list[str]:
    """The columns that aliases name, in the aliases' order."""
    known = header_map(columns)
    return [known[header_key(a)] for a in aliases if header_key(a) in known]

"""The public word-punctuation tokenizer as a built-in expression: tokens match ``\\w+|[^\\w\\s]+``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters, digits and underscore; every white space
LETTERS = r"\p{L}\p{N}_"
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = f"[{LETTERS}]+|[^{LETTERS}{WHITE}]+"


def token_count(text: Column) -> Column:
    """Number of tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long")

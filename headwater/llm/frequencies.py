"""Frequency of every distinct term: suffix arrays with common-prefix intervals.

Each block of whole records is numbered word by word and its suffixes are sorted, truncated to the longest
term asked for and never past the end of a record. Runs of suffixes sharing a prefix of d words are the
intervals of depth d: their length is the number of occurrences of the d-gram. Its number of records is that
length less the duplicate adjacencies, that is pairs of suffixes of one record that follow each other in
suffix order within the interval. Records never cross blocks, so the counts of blocks add up.

Scale: one pass; a block emits one row per distinct term it holds, so a word that half of all records contain
shuffles as one row per block. Blocks close at a fixed number of words, so memory is bounded except by one
record's own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.words import words
from headwater.plans.lineage import spread

BLOCK_WORDS = 2_000_000
BROADCAST_TERMS = 100_000  # term lists up to this length are sent to every task; longer ones are joined


def block_counts(numbers: np.ndarray, records: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For d = 1..depth: (d, start position of one occurrence of each d-gram, occurrences, records)."""
    n = len(numbers)
    if not n:
        return
    left = np.append(np.flatnonzero(np.diff(records)) + 1, n)
    ends = left[np.searchsorted(left, np.arange(n), side="right")]
    columns = []
    for d in range(depth):
        at = np.arange(n) + d
        columns.append(np.where(at < ends, numbers[np.minimum(at, n - 1)], -1))
    if depth <= 2 and n:
        span = int(numbers.max()) + 2
        key = columns[0] if depth == 1 else columns[0] * span + columns[1] + 1
        suffixes = np.argsort(key, kind="stable")
    else:
        suffixes = np.lexsort(columns[::-1])
    of = records[suffixes]
    chain = np.argsort(of, kind="stable")  # suffix order within each record
    first, then = chain[:-1], chain[1:]
    same_record = of[first] == of[then]
    first, then = first[same_record], then[same_record]
    differs = np.zeros(n, dtype=bool)
    differs[0] = True
    for d in range(depth):
        level = columns[d][suffixes]
        differs[1:] |= level[1:] != level[:-1]  # common prefix shorter than d + 1
        interval = np.cumsum(differs) - 1
        count = np.bincount(interval)
        a, b = interval[first], interval[then]
        repeated = np.bincount(a[a == b], minlength=len(count))
        start = np.flatnonzero(differs)
        whole = level[start] >= 0
        yield d + 1, suffixes[start[whole]], count[whole], (count - repeated)[whole]


def ngram_counts(df: DataFrame, text: str, depth: int = 1, only: DataFrame | None = None) -> DataFrame:
    """(term, n, occurrences, records) of all n-grams of 1..depth words of the column ``text``.

    ``only`` (term) restricts the n-grams of two or more words; single words are always all counted. Null and
    empty texts hold no term. A repeated row counts as a record of its own. Empty table: no rows.
    """
    listed = None
    if only is not None and depth > 1:
        only = only.select("term").where("term is not null").distinct()
        if only.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
            listed = frozenset(r.term for r in only.collect() if " " in r.term)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary: dict[str, int] = {}
        numbers: list[int] = []
        records: list[int] = []

        def close() -> Iterator[pd.DataFrame]:
            names = list(vocabulary)
            num = np.fromiter(numbers, dtype=np.int64, count=len(numbers))
            rec = np.repeat(np.arange(len(records)), records)
            for d, start, count, docs in block_counts(num, rec, depth):
                if d == 1:
                    terms = [names[i] for i in num[start]]
                else:
                    if listed is not None:
                        known = [tuple(vocabulary.get(w, -1) for w in t.split(" ")) for t in listed]
                        heads = np.array(sorted({t[0] for t in known if len(t) == d and min(t) >= 0}), dtype=np.int64)
                        keep = np.isin(num[start], heads)
                        start, count, docs = start[keep], count[keep], docs[keep]
                    terms = [" ".join(names[i] for i in num[s : s + d]) for s in start]
                    if listed is not None:
                        keep = np.array([t in listed for t in terms], dtype=bool)
                        terms, count, docs = [t for t in terms if t in listed], count[keep], docs[keep]
                if terms:  # an empty column would have no type
                    yield pd.DataFrame({"term": terms, "n": np.int32(d), "occurrences": count, "records": docs})

        for batch in batches:
            for t in batch["t"]:
                found = words(t)
                if not found:
                    continue
                numbers.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
                records.append(len(found))
                if len(numbers) >= BLOCK_WORDS:
                    yield from close()
                    vocabulary, numbers, records = {}, [], []
        if numbers:
            yield from close()

    texts = spread(df.select(F.col(text).cast("string").alias("t")).where("t is not null"))
    blocks = texts.mapInPandas(scan, "term string, n int, occurrences long, records long")
    if only is not None and depth > 1 and listed is None:
        blocks = blocks.where("n = 1").unionByName(blocks.where("n > 1").join(only, "term", "left_semi"))
    return blocks.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def listed_terms(lists: DataFrame, column: str = "TopTerms") -> DataFrame:
    """The distinct entries (entry, term) of comma-separated lists; term is the entry as a sequence of words.

    Entries are lower-cased, trimmed, with single spaces. Null lists and empty entries give nothing.
    """
    entry = F.explode(F.split(F.lower(F.col(column).cast("string")), ",")).alias("entry")
    entries = lists.select(entry).select(F.trim(F.regexp_replace("entry", r"[\s ]+", " ")).alias("entry"))
    spaced = F.trim(F.regexp_replace("entry", r"[^\p{L}\p{N}]+", " "))
    return entries.where("entry != ''").distinct().withColumn("term", spaced)


def term_frequencies(
    df: DataFrame, text: str, lists: DataFrame | None = None, list_column: str = "TopTerms", rare_below: int = 3, common_above: float = 0.10
) -> DataFrame:
    """Every word of ``text`` and every entry of the lists with its frequency.

    term, occurrences, records, share (of all rows of ``df``, null texts included) and mark: ``rare`` below
    ``rare_below`` records (none included), ``common`` above ``common_above`` of all rows, else ``useful``.
    """
    total = df.count()
    if lists is None:
        counts = ngram_counts(df, text).select("term", "occurrences", "records")
    else:
        entries = listed_terms(lists, list_column)
        longest = entries.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
        grams = ngram_counts(df, text, longest, entries)
        counts = _with_entries(grams, entries)
    share = F.col("records") / F.lit(float(max(total, 1)))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common").otherwise("useful")
    return counts.select("term", "occurrences", "records", share.alias("share"), mark.alias("mark"))


def _with_entries(grams: DataFrame, entries: DataFrame) -> DataFrame:
    """Words, plus entries under their own spelling; an entry that is a plain word is that word's row.

    One aggregation instead of a join with the vocabulary: entries are expanded to (words, spelling) and meet
    the counts in a group-by, an entry without occurrences staying with zeros.
    """
    counted = grams.select("term", F.lit(None).cast("string").alias("entry"), "n", "occurrences", "records")
    asked = entries.select("term", "entry", F.lit(0).alias("n"), F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("records"))
    met = counted.unionByName(asked).groupBy("term").agg(
        F.collect_set("entry").alias("entries"), F.max("n").alias("n"), F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )
    spellings = F.when(F.col("n") == 1, F.array_union(F.array("term"), "entries")).otherwise(F.col("entries"))
    return met.select(F.explode(spellings).alias("term"), "occurrences", "records")

"""Providers of models: embedding, sentiment, entities, narration; each default works offline and says its name.

A provider is a callable on batches of texts, created once per Python worker; a real model is plugged in by
passing another callable.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.words import WORD
from headwater.plans.lineage import spread

# fixed values: a small general lexicon of word valences, -4 to 4
VALENCES = {
    3.0: "love wonderful excellent outstanding brilliant triumph superb",
    2.0: "good great happy win wins won success successful praised applauded welcomed celebrated improved hopeful generous safe thanked popular award",
    1.0: "approved agreed supported gain gains renewed confirmed fresh bright calm steady defended endorsed recovered helpful clear fair",
    -1.0: "delayed doubt doubts question warned warning concern opposed questioned postponed complaint complaints uneven awkward strict dull stalled",
    -2.0: "bad loss losses failed failure fear fears angry blamed rejected criticised damage damaged crisis dispute grievance fiasco bitter fragile shortage hostile",
    -3.0: "terrible awful disaster death deaths killed attack attacks fraud war hate collapse catastrophe",
}
LEXICON = {w: v for v, row in VALENCES.items() for w in row.split()}
NEGATIONS = frozenset("not no never neither nor cannot without hardly rarely seldom".split())
# fixed values: last words that make a name one of an organisation or of a place
ORG_WORDS = frozenset("Agency Alliance Association Bank Board Company Cooperative Council Foundry Group Holdings Inc Institute Labs Ltd Ministry Network Partners Press Trust Union University Works".split())
PLACE_ENDINGS = ("ville", "burg", "ford", "ham", "port", "mouth", "stad", "field", "dale", "haven", "bruck", "sjö", "gård", "bäck", "zów", "ñera", "mère", "ão")


class HashingEmbedder:
    """Signed hashed words at length one: deterministic, a stand-in for a sentence model, not one."""

    name = "hashing-64"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    @staticmethod
    @lru_cache(maxsize=200_000)
    def _hash(word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for k, t in enumerate(texts):
            for w in WORD.findall((t or "").lower()):
                h = self._hash(w)
                out[k, (h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).astype(np.float32).tolist()


class LexiconSentiment:
    """Valences of words, turned by a negation among the three words before; s / sqrt(s*s + 15), from -1 to 1."""

    name = "lexicon"

    def __call__(self, texts: list[str]) -> list[float]:
        return [self.score(t or "") for t in texts]

    @staticmethod
    def score(text: str) -> float:
        words = WORD.findall(text.lower())
        total = 0.0
        for k, w in enumerate(words):
            if (v := LEXICON.get(w)) is not None:
                total += -0.74 * v if NEGATIONS.intersection(words[max(0, k - 3) : k]) else v
        return round(total / math.sqrt(total * total + 15), 4) if total else 0.0


class PatternEntities:
    """Runs of capitalised words: organisations and places by their last word, two or three others are persons."""

    name = "patterns"
    run = re.compile(r"\b[^\W\d_a-zß-ÿ][^\W\d_]+(?: [^\W\d_a-zß-ÿ][^\W\d_]+)*")

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        return [list(self.entities(t or "")) for t in texts]

    def entities(self, text: str) -> Iterator[tuple[str, str]]:
        for m in self.run.finditer(text):
            name = m.group()
            last = name.rsplit(" ", 1)[-1]
            if last in ORG_WORDS and name != last:
                yield name, "ORG"
            elif last.lower().endswith(PLACE_ENDINGS):
                yield last, "GPE"
            elif 2 <= len(name.split(" ")) <= 3:
                yield name, "PERSON"


def embedded(text: Column, provider: Callable | None = None, batch: int = 256) -> Column:
    """Vectors of texts as array<float>; null is embedded as empty."""
    embed = provider or HashingEmbedder()

    def run(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        return pd.Series([v for a in range(0, len(values), batch) for v in embed(values[a : a + batch])])

    return F.pandas_udf(run, "array<float>")(text)


def sentiment(text: Column, provider: Callable | None = None) -> Column:
    score = provider or LexiconSentiment()
    return F.pandas_udf(lambda texts: pd.Series(score(texts.fillna("").tolist()), dtype=float), "double")(text)


def extract_entities(
    df: DataFrame, labels: tuple[str, ...] = ("PERSON", "ORG", "GPE"), text: str = "_text_norm", cluster: str = "Cluster", provider: Callable | None = None, batch: int = 256
) -> DataFrame:
    """(Cluster, Entity, Label) of every mention; names of at least two characters with a letter, in ``labels``."""
    find = provider or PatternEntities()
    kind = df.schema[cluster].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                rows = [(c, e.strip(), g) for c, found in zip(part["c"], find(part["t"].tolist()), strict=True) for e, g in found]
                yield pd.DataFrame(rows, columns=["c", "Entity", "Label"])

    rows = spread(df.select(F.col(cluster).alias("c"), F.col(text).alias("t"))).mapInPandas(run, f"c {kind}, Entity string, Label string")
    kept = rows.where((F.length("Entity") >= 2) & F.col("Entity").rlike("[A-Za-z]") & F.col("Label").isin(*labels))
    return kept.withColumnRenamed("c", cluster)


def top_entities(entities: DataFrame, label: str, top_k: int = 15, cluster: str = "Cluster") -> tuple[DataFrame, DataFrame]:
    """(all counts, the ``top_k`` per cluster) of one label; equal counts by name."""
    from pyspark.sql import Window

    counts = entities.where(F.col("Label") == label).groupBy(cluster, "Entity").agg(F.count("*").alias("Count"))
    w = Window.partitionBy(cluster).orderBy(F.desc("Count"), "Entity")
    return counts, counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).drop("rank")


def sentiment_by_cluster(df: DataFrame, cluster: str = "Cluster", score: str = "Sentiment") -> DataFrame:
    """count, mean, exact median, min and max per cluster; null scores do not count. A missing column is an error."""
    if score not in df.columns:
        raise KeyError(score)
    c = F.col(score)
    return df.groupBy(cluster).agg(
        F.count(c).alias("count"), F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"), F.min(c).alias("min"), F.max(c).alias("max")
    )

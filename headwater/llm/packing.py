"""Filling containers of fixed capacity: packing along a space-filling curve.

Documents are hashed into vectors of words, projected to a few dimensions and put in the order of their
Hilbert key, so that neighbours in the order are alike. Ranges of the curve are packed side by side: best fit,
longest first within a window of neighbours, into containers that stay open along the curve while they have
room. Only a document longer than a container is cut: into full containers and a rest that is packed.

Scale: texts are read once and reduced to (id, tokens, key); only those are shuffled, once. Ranges of about ``RANGE``
documents are cut along a histogram of the keys' first bits, so they are the same in every run; a cell of the histogram
that holds more (a third of all texts alike) is dealt to its ranges by id. Each range leaves a few containers part full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import lru_cache
from math import erf

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.tokens import token_count
from headwater.plans.lineage import cut, spread

CAPACITY, WINDOW, OPEN, RANGE = 1024, 512, 128, 20_000
BUCKETS, DIMENSIONS, BITS, CELL_BITS = 4096, 3, 10, 12


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))


_known: dict[str, int] = {}


def _bucket(word: str) -> int:
    b = _known.get(word)
    if b is None:
        if len(_known) > 500_000:
            _known.clear()
        b = _known[word] = xxhash.xxh32_intdigest(word) % BUCKETS
    return b


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dimensions), each coordinate of ``bits`` bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest cell down
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ (q - 1), x[0])
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: pd.Series) -> pd.Series:
    """Hilbert keys of texts; empty and null texts stand at the middle of the space."""
    table, sums, sizes = _projection(), [], []
    for t in texts:
        found = {_bucket(w) for w in t.lower().split()} if isinstance(t, str) else ()
        sums.append(table[list(found)].sum(axis=0) if found else np.zeros(DIMENSIONS))
        sizes.append(max(len(found), 1))
    z = np.array(sums).reshape(-1, DIMENSIONS) / np.sqrt(np.array(sizes))[:, None]
    unit = 0.5 * (1 + np.vectorize(erf, otypes=[float])(z / np.sqrt(2)))
    return pd.Series(hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))


class _Containers:
    """Open containers by the room they have."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.room = first, capacity, []

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> int:
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, c = self.room.pop(at)
        else:
            room, c = self.capacity, self.fresh()
        if room > size or not size:
            insort(self.room, (room - size, c))
            if len(self.room) > OPEN:
                self.room.pop(0)  # the fullest one closes
        return c


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, piece (from 0), pieces, start and tokens (of the document), container.

    A document of at most ``capacity`` tokens is one piece; longer ones are cut into full containers and a
    rest. Null and empty texts are pieces of no tokens. Every row of ``df`` is a document, repeated ids too.
    Containers are numbered by range of the curve, alike in every run; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    body = F.col(text).cast("string")
    texts = spread(df.select(F.col(key).alias("id"), body.alias("t")))
    sized = cut(texts.select("id", token_count(F.col("t")).alias("tokens"), F.pandas_udf(curve_keys, "long")("t").alias("hilbert")))
    cell = F.shiftright("hilbert", DIMENSIONS * BITS - CELL_BITS).cast("int")
    sizes = sized.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").toPandas()  # at most 2^CELL_BITS rows
    starts = sized.sparkSession.createDataFrame(list(zip(sizes.cell.tolist(), (sizes.n.cumsum() - sizes.n).tolist(), sizes.n.tolist(), strict=True)), "cell int, start long, n long")
    within = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(1 << 53)
    ranged = sized.withColumn("cell", cell).join(F.broadcast(starts), "cell").withColumn("range", F.floor((F.col("start") + within * F.col("n")) / RANGE).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["hilbert", "id", "tokens"], kind="stable")
        open_ = _Containers(int(group["range"].iloc[0]) << 40, capacity)
        rows = []
        for a in range(0, len(group), WINDOW):
            window, rests = group.iloc[a : a + WINDOW], []
            for i, t in zip(window["id"], window["tokens"], strict=True):
                whole, rest = divmod(t, capacity)
                pieces = max(whole + (rest > 0), 1)
                rows += [(i, p, pieces, p * capacity, capacity, open_.fresh()) for p in range(whole)]
                if rest or not whole:
                    rests.append((-rest, len(rests), i, whole, pieces))
            for size, _, i, p, pieces in sorted(rests):
                rows.append((i, p, pieces, p * capacity, -size, open_.place(-size)))
        return pd.DataFrame(rows, columns=["id", "piece", "pieces", "start", "tokens", "container"])

    schema = f"id {kind}, piece int, pieces int, start long, tokens long, container long"
    return ranged.select("id", "tokens", "hilbert", "range").groupBy("range").applyInPandas(pack, schema).withColumnRenamed("id", key)

"""Near-duplicate records: an exact set-similarity join by partition-and-enumerate signatures.

Records are sets of words; pairs whose Jaccard similarity reaches the threshold are found, all of them. The
idea is that of PartEnum: split the feature domain into parts, enumerate subsets of the parts a set touches,
and choose their number by size so that two sufficiently similar sets of compatible sizes must share one
signature. Parts here are the words themselves in a global order from rare to frequent: two similar sets
agree on at least t of the first (allowed misses + t) words of either, so the t-subsets of that prefix are
signatures. How many words a signature takes is decided by frequency alone and hence alike for both sets: one
word if it is rare, two or three if fewer would make a hot bucket. So hot words never form a bucket of their
own, and signatures grow longer as the collection grows. (Hashed parts with the symmetric budget of the
published method do not work at a threshold of 0.65; see the README.)

Within a bucket, sorted by size, sets are compared by 128-bit parity sketches, whose distance never exceeds
the number of differing words; survivors are compared word by word. Identical sets are one class, compared
once. Word frequencies are counted over all records into a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.words import WORD
from headwater.llm.grouping import connected_groups
from headwater.plans.lineage import cut, spread, stage

SLOTS = 1 << 20  # of the frequency table; words are hashed into it, so its size is fixed
HOT = 3000  # expected members of a bucket beyond which its signature takes another word
SIGNATURES, PART = 30, 16 << 20  # what a record takes about, and bytes of entries a task should read at once
LONG = 300  # distinct words from which prefixes are too long to enumerate subsets of
ENTRY = np.dtype([("sig", "<u4"), ("b1", "<u8"), ("b2", "<u8"), ("x", "<u4"), ("n", "<u4")])
_known: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) > 500_000:
            _known.clear()
        h = _known[word] = xxhash.xxh64_intdigest(word)
    return h


def word_sets(texts: list[list], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with at least ``least`` distinct words, their numbers of words, all word hashes row by row)."""
    rows, sizes, hashes = [], [], []
    for k, parts in enumerate(zip(*texts, strict=True)):
        found = set(WORD.findall(" ".join(p if isinstance(p, str) else "" for p in parts).lower()))
        if len(found) >= max(least, 1):
            rows.append(k)
            sizes.append(len(found))
            hashes.extend(map(_hash, found))
    return np.array(rows, dtype=np.int64), np.array(sizes, dtype=np.int64), np.array(hashes, dtype=np.uint64)


def identities(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity sketches of the two halves of the domain and a check word for every set; together they identify it."""
    if not len(sizes):
        return tuple(np.zeros(0, dtype=np.uint64) for _ in range(3))
    start = np.cumsum(sizes) - sizes
    one = np.uint64(1)
    xor = lambda v: np.bitwise_xor.reduceat(v, start)
    bit, second = one << (hashes & np.uint64(63)), (hashes >> np.uint64(6) & one).astype(bool)
    b1 = xor(np.where(second, np.uint64(0), bit))
    b2 = xor(np.where(second, bit, np.uint64(0)))
    x = xor(hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32))
    return b1, b2, x


def _ceil(numerator: int, denominator: int, n: np.ndarray) -> np.ndarray:
    return -((-n * numerator) // denominator)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (b + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))


def signatures(sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, total: int, threshold: Fraction) -> tuple:
    """(set number, 64-bit signature, whether it counts when the set is the smaller one) for all sets."""
    n_sets = len(sizes)
    sets = np.repeat(np.arange(n_sets), sizes)
    freq = counts[(hashes >> np.uint64(12)).astype(np.int64) & (SLOTS - 1)].astype(np.float64)
    order = np.lexsort((hashes, freq, sets))
    hashes, freq = hashes[order], freq[order]
    start = np.cumsum(sizes) - sizes
    p, q = threshold.numerator, threshold.denominator
    misses = sizes - _ceil(p, q, sizes)  # of the larger set of a pair
    fewer = sizes - _ceil(2 * p, p + q, sizes)  # of the smaller one
    short, long_ = sizes * p <= LONG * q, sizes >= LONG - 1
    out = []

    def words(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return hashes[start[ids] + at]

    def often(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return freq[start[ids] + at]

    def prefix(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (element of ids, position) with first <= position < last."""
        width = np.maximum(last - first, 0)
        k = np.repeat(np.arange(len(ids)), width)
        at = np.arange(len(k)) - np.repeat(np.cumsum(width) - width, width) + first[k]
        return k, at

    every = np.arange(n_sets)
    k, at = prefix(every, np.zeros(n_sets, dtype=np.int64), np.minimum(misses + 1, sizes))
    w, c = words(k, at), often(k, at)
    role = at < fewer[k] + 1
    rare = (c <= HOT) & short[k]
    out.append((k[rare], _mix(w[rare], np.uint64(1)), role[rare]))
    out.append((k[long_[k]], _mix(w[long_[k]], np.uint64(4)), role[long_[k]]))
    # a second word for the frequent ones, then a third
    k1, at1 = prefix(every, np.zeros(n_sets, dtype=np.int64), np.minimum(misses + 2, sizes))
    c1 = often(k1, at1)
    hot = (c1 > HOT) & short[k1]
    k1, at1, c1 = k1[hot], at1[hot], c1[hot]
    e, at2 = prefix(k1, at1 + 1, np.minimum(misses[k1] + 2, sizes[k1]))
    k2 = k1[e]
    c2 = c1[e] * often(k2, at2) / total
    both = _mix(_mix(words(k2, at1[e]), np.uint64(2)), words(k2, at2))
    done = c2 <= HOT
    out.append((k2[done], both[done], (at2 < fewer[k2] + 2)[done]))
    k1, at1 = prefix(every, np.zeros(n_sets, dtype=np.int64), np.minimum(misses + 3, sizes))
    c1 = often(k1, at1)
    hot = (c1 > HOT) & short[k1]
    k1, at1, c1 = k1[hot], at1[hot], c1[hot]
    e, at2 = prefix(k1, at1 + 1, np.minimum(misses[k1] + 3, sizes[k1]))
    k2 = k1[e]
    c2 = c1[e] * often(k2, at2) / total
    hot = c2 > HOT
    k2, at2 = k2[hot], at2[hot]
    both = _mix(_mix(words(k2, at1[e][hot]), np.uint64(3)), words(k2, at2))
    e, at3 = prefix(k2, at2 + 1, np.minimum(misses[k2] + 3, sizes[k2]))
    k3 = k2[e]
    out.append((k3, _mix(both[e], words(k3, at3)), at3 < fewer[k3] + 3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def compare(e: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries (smaller, larger) of one signature whose sketches allow the similarity."""
    role = (e["n"] >> np.uint32(31)).astype(bool)
    size = (e["n"] & np.uint32(0x7FFFFFFF)).astype(np.int64)
    order = np.lexsort((e["b1"], e["x"], size, e["sig"]))
    e, role, size = e[order], role[order], size[order]
    sig, b1, b2, x = (np.ascontiguousarray(e[f]) for f in ("sig", "b1", "b2", "x"))
    if len(e) > 1:
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]))
        order, sig, b1, b2, role, size = (v[fresh] for v in (order, sig, b1, b2, role, size))
    n = len(sig)
    if n < 2:
        return order[:0], order[:0]
    edges = np.append(np.flatnonzero(sig[1:] != sig[:-1]) + 1, n)
    end = np.repeat(edges, np.diff(np.append(0, edges)))
    p, q = threshold.numerator, threshold.denominator
    sums = np.arange(2 * int(size.max()) + 1)
    allowed = sums - 2 * _ceil(p, p + q, sums)
    low, high = [], []
    i, d = np.flatnonzero(role & (np.arange(n) + 1 < end)), 1
    while len(i):
        j = i + d
        fits = size[j] * p <= size[i] * q
        if not fits.all():
            i, j = i[fits], j[fits]
        limit = allowed[size[i] + size[j]]
        near = np.flatnonzero(np.bitwise_count(b1[i] ^ b1[j]) <= limit)
        if len(near):
            a, b = i[near], j[near]
            apart = np.bitwise_count(b1[a] ^ b1[b]).astype(np.int64) + np.bitwise_count(b2[a] ^ b2[b])
            near = apart <= limit[near]
            low.append(a[near])
            high.append(b[near])
        d += 1
        i = i[i + d < end[i]]
    if not low:
        return order[:0], order[:0]
    return order[np.concatenate(low)], order[np.concatenate(high)]


def _sketched(df: DataFrame, key: str, fields: list[str], least: int) -> DataFrame:
    """Staged: the set of every eligible record (kind 0: id, b1, b2, x, n) and word frequencies (kind 1: slot, count)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            rows, sizes, hashes = word_sets([b[f"t{k}"] for k in range(len(fields))], least)
            b1, b2, x = identities(sizes, hashes)
            counts += np.bincount((hashes >> np.uint64(12)).astype(np.int64) & (SLOTS - 1), minlength=SLOTS)
            yield pd.DataFrame({"kind": np.int8(0), "id": b["id"].to_numpy()[rows], "b1": b1.view(np.int64), "b2": b2.view(np.int64), "x": x.astype(np.int64), "n": sizes})
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"kind": np.int8(1), "id": used, "b1": counts[used], "b2": np.int64(0), "x": np.int64(0), "n": np.int64(0)})

    return stage(_texts(df, key, fields).mapInPandas(scan, "kind byte, id long, b1 long, b2 long, x long, n long"))


def _texts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    texts = df.select(F.col(key).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"t{k}") for k, f in enumerate(fields)))
    return spread(texts.where("id is not null"))


def similar_sets(df: DataFrame, key: str, fields: list[str], threshold: float = 0.8, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(members: id, b1, b2, x; pairs: b1, b2, x, c1, c2, y, common, n, m) of the word sets of the records.

    ``members`` has every record with at least ``least`` distinct words and names its set; ``pairs`` has every
    unordered pair of different sets whose similarity is at least ``threshold``, once. Nothing is capped.
    """
    spark = df.sparkSession
    gamma = Fraction(str(threshold))
    sketched = _sketched(df, key, fields, least)
    members = sketched.where("kind = 0").select("id", "b1", "b2", "x", "n")
    found = sketched.where("kind = 1").groupBy("id").agg(F.sum("b1").alias("c")).toPandas()  # at most SLOTS rows
    counts = np.zeros(SLOTS, dtype=np.int32)
    counts[found.id.to_numpy()] = found.c.clip(upper=2**31 - 1).to_numpy()
    total = max(members.count(), 1)
    table = spark.sparkContext.broadcast(counts)  # SLOTS * 4 bytes, whatever the data
    # how many parts the buckets are dealt to follows the data, so that what a task reads does not; the result is the same
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * SIGNATURES * ENTRY.itemsize // PART))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, sizes, hashes = word_sets([b[f"t{k}"] for k in range(len(fields))], least)
            if not len(sizes):
                continue
            b1, b2, x = identities(sizes, hashes)
            # one entry per distinct set of the batch
            _, first = np.unique(np.stack([b1, b2, x]), axis=1, return_index=True)
            if len(first) < len(sizes):
                keep = np.zeros(len(sizes), dtype=bool)
                keep[first] = True
                hashes, sizes, b1, b2, x = hashes[np.repeat(keep, sizes)], sizes[keep], b1[keep], b2[keep], x[keep]
            at, sig, role = signatures(sizes, hashes, table.value, total, gamma)
            part = (sig >> np.uint64(32)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            at, part = at[order], part[order]
            e = np.empty(len(at), dtype=ENTRY)
            e["sig"], e["b1"], e["b2"], e["x"] = sig[order].astype(np.uint32), b1[at], b2[at], x[at].astype(np.uint32)
            e["n"] = sizes[at].astype(np.uint32) | (role[order].astype(np.uint32) << np.uint32(31))
            cuts = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
            begin = np.append(0, cuts[:-1])
            yield pd.DataFrame({"part": part[begin].astype(np.int32), "entries": [e[a:b].tobytes() for a, b in zip(begin, cuts, strict=True)]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        e = np.frombuffer(b"".join(group["entries"]), dtype=ENTRY)
        a, b = compare(e, gamma)
        ids = np.stack([e["b1"][a].view(np.int64), e["b2"][a].view(np.int64), e["x"][a].astype(np.int64), e["b1"][b].view(np.int64), e["b2"][b].view(np.int64), e["x"][b].astype(np.int64)], axis=1)
        flip = [tuple(r[:3]) > tuple(r[3:]) for r in ids.tolist()]
        ids[flip] = ids[flip][:, [3, 4, 5, 0, 1, 2]]
        return pd.DataFrame(np.unique(ids, axis=0), columns=["b1", "b2", "x", "c1", "c2", "y"])

    blobs = _texts(df, key, fields).mapInPandas(sign, "part int, entries binary")
    candidates = blobs.repartition(parts, "part").groupBy("part").applyInPandas(meet, "b1 long, b2 long, x long, c1 long, c2 long, y long")
    candidates = stage(candidates.distinct())

    # the words of the sets that are candidates, from one record each
    asked = candidates.select("b1", "b2", "x").unionAll(candidates.select("c1", "c2", "y")).distinct()
    chosen = members.join(asked, ["b1", "b2", "x"]).groupBy("b1", "b2", "x").agg(F.min("id").alias("id"))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, sizes, hashes = word_sets([b[f"t{k}"] for k in range(len(fields))], 1)
            lists = np.split(hashes.view(np.int64), np.cumsum(sizes)[:-1])
            yield pd.DataFrame({"b1": b["b1"], "b2": b["b2"], "x": b["x"], "words": lists})

    texts = _texts(df, key, fields).join(chosen, "id").select("b1", "b2", "x", *(f"t{k}" for k in range(len(fields))))
    spelled = stage(texts.mapInPandas(spell, "b1 long, b2 long, x long, words array<long>"))
    other = spelled.select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("x").alias("y"), F.col("words").alias("others"))
    met = candidates.join(spelled, ["b1", "b2", "x"]).join(other, ["c1", "c2", "y"])
    common, n, m = F.size(F.array_intersect("words", "others")), F.size("words"), F.size("others")
    met = met.select("b1", "b2", "x", "c1", "c2", "y", common.alias("common"), n.alias("n"), m.alias("m"))
    similar = met.where(F.col("common") * gamma.denominator >= (F.col("n") + F.col("m") - F.col("common")) * gamma.numerator)
    return members, stage(similar)


def near_duplicate_pairs(df: DataFrame, key: str, fields: list[str], threshold: float = 0.8, least: int = 20) -> DataFrame:
    """(i, j) with i < j for every two records whose distinct words are similar, identical sets included."""
    members, pairs = similar_sets(df, key, fields, threshold, least)
    names = ["b1", "b2", "x"]
    left = members.select(F.col("id").alias("l"), *names)
    right = members.select(F.col("id").alias("r"), F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("x").alias("y"))
    different = pairs.select(*names, "c1", "c2", "y").join(left, names).join(right, ["c1", "c2", "y"]).select("l", "r")
    several = members.groupBy(*names).agg(F.count("*").alias("k")).where("k > 1").select(*names)
    copies = left.join(several, names)
    same = copies.join(copies.select(F.col("l").alias("r"), *names), names).where("l < r").select("l", "r")
    both = different.unionAll(same)
    return both.select(F.least("l", "r").alias("i"), F.greatest("l", "r").alias("j"))


def near_duplicate_groups(df: DataFrame, key: str, fields: list[str], threshold: float = 0.8, least: int = 20) -> DataFrame:
    """One row per record of a group: id, group_id (smallest id of the group), copies of its own set, links.

    ``links`` is the number of other sets its set is similar to; identical sets are one class and are not
    expanded into pairs. Records with fewer than ``least`` distinct words or without any similar one are in no
    group. Null ids are left out, null texts are empty, repeated rows are copies; empty tables give no rows.
    """
    names = ["b1", "b2", "x"]
    members, pairs = similar_sets(df, key, fields, threshold, least)
    classes = stage(members.groupBy(*names).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    one = classes.select(*names, F.col("rep").alias("a"))
    two = classes.select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("x").alias("y"), F.col("rep").alias("b"))
    links = cut(pairs.join(one, names).join(two, ["c1", "c2", "y"]).select("a", "b"))
    groups = connected_groups(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    grouped = classes.join(groups.withColumnRenamed("row_id", "rep"), "rep", "left").join(degree, "rep", "left")
    grouped = grouped.where("group_id is not null or copies > 1")
    grouped = grouped.select(*names, F.coalesce("group_id", "rep").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(grouped, names).select(F.col("id").alias(key), "group_id", "copies", "links")

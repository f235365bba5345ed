"""Grouping posts into themes: Markov clustering with sparse distributed matrix squaring.

The graph has two kinds of nodes, words and posts. Two words are joined by how much more often than by chance they
share a post (their lift, taken at the lower end of its error); a post leads to its words, and no node leads to a
post. So the matrix of the process falls into the words' columns and the posts' columns:

* the words' columns are squared, inflated and pruned, block by block, until they stand still; the attractor systems
  of that limit are the clusters;
* a post's own column begins with its words, each as strongly as it is tied to the others of the post and as
  specific as it is; multiplied with the limit it is the post's flow to the attractors. The attractor system with
  most of it is the post's cluster, and the posts with most flow represent the cluster.

Two words of one language lift each other, two words of a theme more so; an edge weighs its lift against the level
of the two words (the usual lift of their strongest edges), to a power. Words of one sentence are not paired, or
set phrases would look like themes. A group of words is a theme if its words share posts at least ``LIFT`` times as
often as chance has it, and if at least ``min_share`` of the posts flow to it first of all; posts of other groups
follow the next strongest flow.

Scale: texts are tokenised twice, to count the words and to write every post as numbers of the counted ones; all
else reads these. A word must stand in ``min_share`` of the posts, so there are at most (mean distinct words) /
min_share of them, and an edge in a tenth of that, so there are at most 5 (mean distinct words)^2 / min_share edges,
whatever the number of posts. Word counts and pairs are summed within a task first. Work on posts is linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.words import WORD
from headwater.plans.joins import small_side
from headwater.plans.lineage import cut, spread, stage

SENTENCE = re.compile(r"[.!?;:]\s")
MIN_SHARE, MIN_POSTS, PAIR_SHARE = 0.001, 4, 0.1
LIFT, ERRORS, STRONGEST, POWER = 2.0, 2.0, 15, 4  # least lift, standard errors taken off it, edges that make a word's level, power of an edge and of a level
INFLATION, PRUNE, STILL, ROUNDS = 1.5, 1e-3, 1e-3, 200
BLOCK, PRODUCTS = 2048, 4_000_000  # nodes of a block of the matrix; products held at once
DENSE, HELD = 5000, 8_000_000  # words up to which a task adds pairs up in a matrix, else in sorted runs; pairs held between additions


def _post_words(batch: pd.DataFrame, fields: int) -> Iterator[dict[str, int]]:
    """Of each post its words with the number of the sentence they stand in, -1 if they stand in several."""
    for parts in zip(*(batch[f"t{k}"] for k in range(fields)), strict=True):
        found: dict[str, int] = {}
        at = 0
        for p in parts:
            if not isinstance(p, str):
                continue
            for sentence in SENTENCE.split(p.lower()):
                for w in WORD.findall(sentence):
                    if found.setdefault(w, at) != at:
                        found[w] = -1
                at += 1
        yield found


def _texts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return spread(df.select(F.col(key).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"t{k}") for k, f in enumerate(fields))))


def vocabulary(df: DataFrame, key: str, fields: list[str], min_share: float = MIN_SHARE) -> tuple[pd.DataFrame, int]:
    """(word, posts) of the words in at least ``min_share`` of the posts, and the number of posts with words."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        posts = 0
        for b in batches:
            for found in _post_words(b, len(fields)):
                posts += bool(found)
                for w in found:
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) > 500_000:
                yield pd.DataFrame({"word": list(counts), "posts": list(counts.values())})
                counts = {}
        yield pd.DataFrame({"word": [*counts, ""], "posts": [*counts.values(), posts]})

    summed = cut(_texts(df, key, fields).mapInPandas(scan, "word string, posts long").groupBy("word").agg(F.sum("posts").alias("posts")))
    total = (summed.where("word = ''").agg(F.sum("posts")).first()[0]) or 0
    kept = summed.where((F.col("word") != "") & (F.col("posts") >= max(MIN_POSTS, min_share * total)))
    return kept.orderBy(F.desc("posts"), "word").toPandas(), total


def numbered(df: DataFrame, key: str, fields: list[str], words: list[str]) -> DataFrame:
    """Staged (id, n, ws, at): of every post its number of words, those of the vocabulary as numbers, in order, and their sentences."""
    number = {w: k for k, w in enumerate(words)}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, ws, at = [], [], []
            for found in _post_words(b, len(fields)):
                own = sorted((number[w], s) for w, s in found.items() if w in number)
                n.append(len(found))
                ws.append([k for k, _ in own])
                at.append([s for _, s in own])
            yield pd.DataFrame({"id": b["id"], "n": n, "ws": ws, "at": at})

    return stage(_texts(df, key, fields).mapInPandas(scan, "id long, n int, ws array<int>, at array<int>"))


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and the length of each."""
    lengths = lists.map(len).to_numpy(dtype=np.int64)
    return (np.concatenate(lists.to_list()) if len(lists) else np.zeros(0)).astype(np.int64), lengths


def _runs(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[start], np.add.reduceat(counts, start) if len(start) else counts[:0]


def together(posts: DataFrame, size: int, dense: int = DENSE) -> DataFrame:
    """(a, b, n) with a < b: in how many posts (of :func:`numbered`) two of the ``size`` words stand in different sentences.

    A task sums up before it emits: in a matrix if there are at most ``dense`` words, else in sorted runs; the result is the same.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = np.zeros(size * size, dtype=np.int32) if size <= dense else None
        codes_, counts_ = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        waiting, held = [], 0

        def add() -> None:
            nonlocal matrix, codes_, counts_
            new = np.concatenate(waiting)
            if matrix is not None:
                matrix += np.bincount(new, minlength=size * size).astype(np.int32)
            else:
                new, n = np.unique(new, return_counts=True)
                codes_, counts_ = _runs(np.concatenate([codes_, new]), np.concatenate([counts_, n]))

        for b in batches:
            flat, n = _flat(b["ws"])
            where, _ = _flat(b["at"])
            at, end, d = np.arange(len(flat)), np.repeat(np.cumsum(n), n), 1
            at = at[at + d < end[at]] if len(at) else at
            while len(at):
                apart = (where[at] < 0) | (where[at] != where[at + d])
                codes = (flat[at] * size + flat[at + d])[apart]
                waiting.append(codes)
                held += len(codes)
                if held >= HELD:
                    add()
                    waiting, held = [], 0
                    if len(codes_) > HELD:
                        yield pd.DataFrame({"a": codes_ // size, "b": codes_ % size, "n": counts_})
                        codes_, counts_ = codes_[:0], counts_[:0]
                d += 1
                at = at[at + d < end[at]]
        if waiting:
            add()
        if matrix is not None:
            codes_ = np.flatnonzero(matrix)
            counts_ = matrix[codes_]
        yield pd.DataFrame({"a": codes_ // size, "b": codes_ % size, "n": counts_})

    pairs = spread(posts.select("ws", "at")).mapInPandas(scan, "a int, b int, n long")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def word_edges(pairs: DataFrame, words: DataFrame, total: int, usual: float, least: float) -> DataFrame:
    """(a, b, lift) of the pairs in more than ``least`` posts that are together ``LIFT`` times as often as by chance, beyond doubt.

    ``words`` (k, posts) is the vocabulary; ``usual`` is what two words of no connection have (pairs within a
    sentence do not count, so it is below 1). ``lift`` has its error taken off.
    """
    one = words.select(F.col("k").alias("a"), F.col("posts").alias("pa"))
    two = words.select(F.col("k").alias("b"), F.col("posts").alias("pb"))
    chance = F.col("pa") * F.col("pb") / F.lit(float(max(total, 1))) * F.lit(usual)
    lift = (F.col("n") - ERRORS * F.sqrt(F.col("n").cast("double"))) / chance
    rated = pairs.where(F.col("n") >= least).join(small_side(one), "a").join(small_side(two), "b")
    return rated.select("a", "b", lift.alias("lift")).where(F.col("lift") >= LIFT)


def word_levels(edges: DataFrame) -> DataFrame:
    """(k, level): the median lift of the strongest edges of every word that has any."""
    ends = edges.select(F.col("a").alias("k"), "lift").unionAll(edges.select(F.col("b").alias("k"), "lift"))
    best = ends.groupBy("k").agg(F.slice(F.sort_array(F.collect_list("lift"), asc=False), 1, STRONGEST).alias("l"))
    return best.select("k", F.expr("(l[cast((size(l) - 1) div 2 as int)] + l[cast(size(l) div 2 as int)]) / 2").alias("level"))


def word_graph(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(a, b, w): the edges (a, b, lift) weighed against the higher level of their two words."""
    one, two = levels.select(F.col("k").alias("a"), F.col("level").alias("la")), levels.select(F.col("k").alias("b"), F.col("level").alias("lb"))
    share = F.least(F.lit(1.0), F.col("lift") / F.greatest("la", "lb"))
    return edges.join(small_side(one), "a").join(small_side(two), "b").select("a", "b", F.pow(share, F.lit(float(POWER))).alias("w"))


def _product(left: pd.DataFrame, right: pd.DataFrame, first: int, second: int, block: int) -> pd.DataFrame:
    """The block of the product of two matrices (i, j, v): rows from ``first``, columns from ``second`` on, ``block`` of each."""
    left = left.sort_values("j", kind="stable")
    k, i, u = left.j.to_numpy(), left.i.to_numpy() - first, left.v.to_numpy()
    m, j, v = right.i.to_numpy(), right.j.to_numpy() - second, right.v.to_numpy()
    start, stop = np.searchsorted(k, m, "left"), np.searchsorted(k, m, "right")
    width, out = stop - start, np.zeros(block * block)
    upto = np.cumsum(width)
    a = 0
    while a < len(m):  # entries of the right factor whose products are made at once
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PRODUCTS, "right")))
        w = width[a:b]
        at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[a:b], w)
        codes = i[at].astype(np.int64) * block + np.repeat(j[a:b], w)
        out += np.bincount(codes, u[at] * np.repeat(v[a:b], w), minlength=block * block)
        a = b
    found = np.flatnonzero(out)
    return pd.DataFrame({"i": first + found // block, "j": second + found % block, "v": out[found]})


def _stochastic(entries: DataFrame, inflation: float, block: int) -> DataFrame:
    """The columns j of (i, j, v) inflated, normalised, pruned of entries below ``PRUNE`` and normalised again."""

    def columns(g: pd.DataFrame) -> pd.DataFrame:
        i, v = g.i.to_numpy(), g.v.to_numpy() ** inflation
        names, j = np.unique(g.j.to_numpy(), return_inverse=True)
        v = v / np.bincount(j, v)[j]
        top = np.zeros(len(names))
        np.maximum.at(top, j, v)
        keep = (v >= PRUNE) | (v == top[j])  # a column never becomes empty
        i, j, v = i[keep], j[keep], v[keep]
        return pd.DataFrame({"i": i, "j": names[j], "v": v / np.bincount(j, v)[j]})

    blocks = entries.select("i", "j", "v", F.floor(F.col("j") / block).cast("int").alias("z"))
    return blocks.groupBy("z").applyInPandas(columns, "i int, j int, v double")


def squared(flow: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """(i, j, v): the matrix times itself, a task for every block of the result, which gets its rows and its columns."""
    blocks = -(-size // block)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = flow.select("i", "j", "v", F.floor(F.col("i") / block).cast("int").alias("x"), every.alias("z"), F.lit(True).alias("left"))
    columns = flow.select("i", "j", "v", every.alias("x"), F.floor(F.col("j") / block).cast("int").alias("z"), F.lit(False).alias("left"))

    def multiply(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return _product(g[g.left], g[~g.left], key[0] * block, key[1] * block, block)

    return rows.unionAll(columns).groupBy("x", "z").applyInPandas(multiply, "i int, j int, v double")


def markov_clusters(edges: DataFrame, inflation: float = INFLATION, block: int = BLOCK) -> DataFrame:
    """(j, i, v): the limit of the Markov process on a graph (a, b, w): the flow of every node to its attractors.

    Each node gets a loop as heavy as its heaviest edge. The process ends when no column changes any more. No edges:
    an empty table.
    """
    both = edges.select(F.col("a").cast("int").alias("i"), F.col("b").cast("int").alias("j"), F.col("w").cast("double").alias("v"))
    both = both.unionAll(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    loops = both.groupBy("j").agg(F.max("v").alias("v")).select(F.col("j").alias("i"), "j", "v")
    flow = cut(_stochastic(both.unionAll(loops), 1.0, block))
    size = (flow.agg(F.max("j")).first()[0] if not flow.isEmpty() else -1) + 1
    for _ in range(ROUNDS if size else 0):
        flow = cut(_stochastic(squared(flow, size, block), inflation, block))
        columns = flow.groupBy("j").agg((F.max("v") - F.sum(F.col("v") * F.col("v"))).alias("chaos"))
        if columns.agg(F.max("chaos")).first()[0] < STILL:
            return flow
    if size:
        raise RuntimeError(f"still moving after {ROUNDS} rounds")
    return flow


def _systems(flow: pd.DataFrame, size: int) -> np.ndarray:
    """The attractor system of each word (its smallest word), -1 for words that are no nodes."""
    best = flow.sort_values(["j", "v", "i"], ascending=[True, False, True]).drop_duplicates("j")
    root = np.arange(size)
    root[best.j.to_numpy()] = best.i.to_numpy()
    pairs = best[best.i != best.j]
    while True:  # nodes of one system hang together through the attractors they flow to
        new = root.copy()
        np.minimum.at(new, pairs.i.to_numpy(), root[pairs.j.to_numpy()])
        np.minimum.at(new, pairs.j.to_numpy(), root[pairs.i.to_numpy()])
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.full(size, -1)
    out[best.j.to_numpy()] = root[best.j.to_numpy()]
    return out


def theme_model(df: DataFrame, key: str, fields: list[str], min_share: float = MIN_SHARE, inflation: float = INFLATION) -> list[dict]:
    """The passes over the posts: each with the words of its themes (``cores``) and every post's flow to them (``flows``, a staged table).

    Themes whose words are too rare among all posts are looked for among the posts left over, those that hold at most
    one word of their cluster, again until a pass finds nothing. There a word counts only if most of its posts are
    left over. An empty table gives one pass without themes.
    """
    passes, left, whole = [], df, None
    while True:
        latest = _pass_model(left, key, fields, min_share, inflation, whole)
        if passes and not latest["cores"]:
            return passes
        passes.append(latest)
        if not latest["cores"]:
            return passes
        whole = whole or (latest["total"], latest["usual"], dict(zip(latest["words"], latest["posts"], strict=True)))
        over = latest["flows"].where("n > 0 and (size(flows) = 0 or flows[0].words < 2)").select(F.col("id").alias(key)).distinct()
        left = stage(left.select(key, *fields).join(small_side(over), key, "left_semi"))


def _pass_model(df: DataFrame, key: str, fields: list[str], min_share: float, inflation: float, whole: tuple[int, float, dict] | None) -> dict:
    """One pass of :func:`theme_model`; ``whole`` is what chance is measured by: the number of all posts, what is usual, and the posts of known words."""
    spark = df.sparkSession
    vocab, total = vocabulary(df, key, fields, min_share)
    own = total
    if whole:
        vocab = vocab[np.array([n >= 0.5 * whole[2].get(w, 0) for w, n in zip(vocab.word, vocab.posts, strict=True)], dtype=bool)]
        total = whole[0]
    words, posts = vocab.word.tolist(), vocab.posts.to_numpy().astype(float)
    rows = numbered(df, key, fields, words)
    none = rows.select("id", "n", F.expr("cast(array() as array<struct<cluster: int, flow: double, words: int>>)").alias("flows"))
    model = {"words": words, "posts": posts, "total": total, "usual": 1.0, "cores": [], "flows": none}
    if not words:
        return model
    pairs = stage(together(rows, len(words)))
    all_pairs = float(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    model["usual"] = usual = whole[1] if whole else all_pairs * total / max(float((posts.sum() ** 2 - (posts**2).sum()) / 2), 1.0)
    listed = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(words), dtype=np.int32), "posts": posts}), "k int, posts double")
    edges = cut(word_edges(pairs, listed, total, usual or 1.0, PAIR_SHARE * min_share * own))
    levels = cut(word_levels(edges))
    limit = markov_clusters(word_graph(edges, levels), inflation).toPandas()  # as many entries as there are words
    if not len(limit):
        return model
    system = _systems(limit, len(words))
    # a theme's words lift each other; what is left of chance does not
    of = small_side(spark.createDataFrame(pd.DataFrame({"k": np.flatnonzero(system >= 0).astype(np.int32), "c": system[system >= 0].astype(np.int32)}), "k int, c int"))
    inner = pairs.join(of.select(F.col("k").alias("a"), "c"), "a").join(of.select(F.col("k").alias("b"), F.col("c").alias("d")), "b").where("c = d")
    shared = inner.groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    mass = lambda v: np.bincount(system[system >= 0], v[system >= 0], minlength=len(words))
    chance = (mass(posts) ** 2 - mass(posts**2)) / 2 / total * usual
    real = [int(c) for c, n in zip(shared.c, shared.n, strict=True) if n >= LIFT * chance[c]]
    level = np.zeros(len(words))
    ranked = levels.toPandas()
    level[ranked.k.to_numpy()] = ranked.level.to_numpy()
    flows = stage(_flows(rows, edges.toPandas(), limit, system, level, real))
    first = flows.where("size(flows) > 0").groupBy(F.col("flows")[0].cluster.alias("c")).agg(F.count("*").alias("n")).toPandas()
    held = first[first.n >= max(MIN_POSTS, min_share * own)].sort_values(["n", "c"], ascending=[False, True])
    number = {int(c): k for k, c in enumerate(held.c)}
    renamed = F.expr(f"map({', '.join(f'{c}, {k}' for c, k in number.items())})") if number else F.expr("cast(map() as map<int, int>)")
    known = F.filter("flows", lambda x: F.map_contains_key(renamed, x.cluster))
    model["flows"] = flows.select("id", "n", F.transform(known, lambda x: F.struct(renamed[x.cluster].alias("cluster"), x.flow.alias("flow"), x.words.alias("words"))).alias("flows"))
    strongest = limit.sort_values(["v", "j"], ascending=[False, True]).j.drop_duplicates()
    model["cores"] = [[words[j] for j in strongest if system[j] == c] for c in held.c]
    return model


def _flows(rows: DataFrame, edges: pd.DataFrame, limit: pd.DataFrame, system: np.ndarray, level: np.ndarray, real: list[int]) -> DataFrame:
    """(id, n, flows): of every post its column, multiplied with the limit, by attractor system: (cluster, flow, words), most flow first.

    ``words`` is how many words of the system the post holds. Only the systems ``real`` take part.
    """
    size = len(system)
    a, b, lift = edges.a.to_numpy(dtype=np.int64), edges.b.to_numpy(dtype=np.int64), edges.lift.to_numpy()
    codes = a * size + b
    order = np.argsort(codes)
    part = np.isin(system, real)
    limit = limit[part[limit.i.to_numpy()] & part[limit.j.to_numpy()]].sort_values("j", kind="stable")
    table = (codes[order], lift[order], limit.j.to_numpy(), system[limit.i.to_numpy()], limit.v.to_numpy(), part, level, system)
    shared = rows.sparkSession.sparkContext.broadcast(table)  # of the words and their edges, bounded whatever the number of posts

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, lift, column, into, share, part, level, system = shared.value
        begin, stop = np.searchsorted(column, np.arange(size), "left"), np.searchsorted(column, np.arange(size), "right")
        for batch in batches:
            flat, lengths = _flat(batch["ws"])
            post = np.repeat(np.arange(len(batch)), lengths)
            keep = part[flat] if len(flat) else np.zeros(0, dtype=bool)
            w, post = flat[keep], post[keep]
            ties, end = np.zeros(len(w)), np.searchsorted(post, post, "right")
            at, d = np.arange(len(w)), 1
            at = at[at + d < end[at]] if len(at) else at
            while len(at):
                code = w[at] * size + w[at + d]
                k = np.searchsorted(codes, code).clip(0, max(len(codes) - 1, 0))
                tie = np.where(codes[k] == code, lift[k], 0.0)
                ties[at] += tie
                ties[at + d] += tie
                d += 1
                at = at[at + d < end[at]]
            tied = np.bincount(post, ties, minlength=len(batch))[post] > 0 if len(w) else ties > 0
            mass = np.where(tied, ties, 1.0) * level[w] ** POWER
            # the product with the limit: every word's mass goes where the word's column goes
            width = stop[w] - begin[w]
            pick = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin[w], width)
            owner, goal, value = np.repeat(post, width), into[pick], np.repeat(mass, width) * share[pick]
            key, where = np.unique(np.concatenate([owner * size + goal, post * size + system[w]]), return_inverse=True)
            reach = np.bincount(where[: len(owner)], value, minlength=len(key))
            words = np.bincount(where[len(owner) :], minlength=len(key))
            owner, goal = key // size, key % size
            some = reach > 0
            owner, goal, reach, words = owner[some], goal[some], reach[some], words[some]
            reach = reach / np.bincount(owner, reach, minlength=len(batch))[owner]
            best = np.lexsort((goal, -words, -reach, owner))
            lists: list[list] = [[] for _ in range(len(batch))]
            for o, c, f, n in zip(owner[best].tolist(), goal[best].tolist(), reach[best].tolist(), words[best].tolist(), strict=True):
                lists[o].append({"cluster": c, "flow": f, "words": n})
            yield pd.DataFrame({"id": batch["id"], "n": batch["n"], "flows": lists})

    return spread(rows.select("id", "n", "ws")).mapInPandas(scan, "id long, n int, flows array<struct<cluster: int, flow: double, words: int>>")


def themes(df: DataFrame, key: str, fields: list[str], min_share: float = MIN_SHARE, inflation: float = INFLATION, model: list[dict] | None = None) -> DataFrame:
    """One row per post: key, cluster, flow and words (of the cluster, in the post).

    The cluster is the attractor system with most of the post's flow, ``flow`` its share. cluster is null for posts
    that hold no word of any cluster (null, blank, remarks). A post left over by one pass (see :func:`theme_model`)
    is in a cluster of a later one if it holds at least two of its words; clusters of later passes are numbered after
    those of earlier ones. Null ids are ids of their own. Repeated rows give repeated results; an empty table gives an
    empty table.
    """
    model = model or theme_model(df, key, fields, min_share, inflation)
    first = F.get("flows", F.lit(0))
    out = model[0]["flows"].select(F.col("id").alias(key), first.cluster.alias("cluster"), first.flow.alias("flow"), F.coalesce(first.words, F.lit(0)).alias("words"))
    base = len(model[0]["cores"])
    for m in model[1:]:
        found = m["flows"].select(F.col("id").alias(key), F.struct(first.words.alias("words"), first.flow.alias("flow"), (first.cluster + base).alias("cluster")).alias("later"))
        found = found.where("later.words > 1").groupBy(key).agg(F.max("later").alias("later"))
        out = out.join(small_side(found), key, "left")
        moved = F.col("later").isNotNull() & (F.col("words") < 2)
        out = out.select(key, *(F.when(moved, F.col(f"later.{c}")).otherwise(F.col(c)).alias(c) for c in ("cluster", "flow", "words")))
        base += len(m["cores"])
    return out


def theme_report(assigned: DataFrame, key: str, model: list[dict], typical: int = 5) -> DataFrame:
    """One row per cluster: cluster, size, its first words, and the ``typical`` posts with the strongest flow."""
    spark = assigned.sparkSession
    assigned = cut(assigned)  # read twice, made once
    w = Window.partitionBy("cluster").orderBy(F.desc("flow"), F.desc("words"), key)
    sizes = assigned.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"))
    ranked = assigned.where("cluster is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    best = ranked.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rank", key))).alias("r")).select("cluster", F.col(f"r.{key}").alias("typical"))
    names = spark.createDataFrame([(k, ", ".join(c[:8])) for k, c in enumerate(c for m in model for c in m["cores"])], "cluster int, terms string")
    return sizes.join(best, "cluster").join(names, "cluster", "left")


def same_theme(assigned: DataFrame, pairs: DataFrame, key: str, i: str = "i", j: str = "j") -> DataFrame:
    """The rows of ``pairs`` (i, j) whose two posts are in one cluster; a post in none shares it with nobody."""
    known = cut(assigned.where("cluster is not null").select(F.col(key).alias("id"), "cluster"))  # read twice, made once
    first = known.select(F.col("id").alias(i), F.col("cluster").alias("ci"))
    second = known.select(F.col("id").alias(j), F.col("cluster").alias("cj"))
    return pairs.select(i, j).join(first, i).join(second, j).where("ci = cj").select(i, j)

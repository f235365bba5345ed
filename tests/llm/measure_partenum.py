"""Measures, for the README, what PartEnum with hashed parts would compare: python tests/llm/measure_partenum.py [folder].

Of all posts of 31 to 47 distinct words (one size band at a similarity of 0.65, 19 words may differ): the share of
random pairs of posts that have a signature in common, and the share of the posts in the largest bucket.
"""

from __future__ import annotations

import itertools
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from headwater.llm.neardup import word_sets

BUDGET, PAIRS = 19, 200_000


def signatures(hashes: np.ndarray, starts: np.ndarray, first: int, second: int) -> np.ndarray:
    """(posts, signatures): for every first-level part all subsets of its second-level parts that may agree."""
    parts, mixed = first * second, (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes >> np.uint64(31))
    part = (hashes % np.uint64(parts)).astype(np.int64)
    sums = np.stack([np.add.reduceat(np.where(part == k, mixed, np.uint64(0)), starts) for k in range(parts)], axis=1)
    misses = -(-(BUDGET + 1) // first) - 1
    out = []
    for f in range(first):
        for chosen in itertools.combinations(range(second), second - misses):
            h = np.full(len(starts), np.uint64(len(out) + 1))
            for c in chosen:
                h = (h ^ sums[:, f * second + c]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out.append(h)
    return np.stack(out, axis=1)


def main(folder: str) -> None:
    t = pq.read_table(f"{folder}/clean.parquet", columns=["Title", "Snippet"])
    _, sizes, hashes = word_sets([t["Title"].to_pylist(), t["Snippet"].to_pylist()], 1)
    band = (sizes >= 31) & (sizes <= 47)
    hashes, sizes = hashes[np.repeat(band, sizes)], sizes[band]
    starts = np.cumsum(sizes) - sizes
    a, b = np.random.default_rng(1).integers(0, len(sizes), (2, PAIRS))
    print(len(sizes), "posts")
    for first, second in ((20, 1), (7, 4), (4, 6)):
        s = signatures(hashes, starts, first, second)
        largest = max(Counter(s[:, k].tolist()).most_common(1)[0][1] for k in range(s.shape[1]))
        met = (s[a] == s[b]).any(axis=1)[a != b].mean()
        print(f"{first} x {second} parts, {s.shape[1]} signatures: {met:.1%} of the pairs meet, largest bucket {largest / len(sizes):.1%} of the posts")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")

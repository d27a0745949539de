"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import numpy as np


def subwords(words: list[str], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character n-grams, its ends marked, and of the word itself: all in one array, and how many each has."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(points))
    hashes, owners, rolled = [], [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, high + 1):
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
        if n >= low:
            whole = at[: len(rolled)] + n <= ends[: len(rolled)]
            hashes.append(rolled[whole])
            owners.append(owner[: len(rolled)][whole])
    full, first = np.zeros(len(words), dtype=np.uint64), np.cumsum(lengths) - lengths
    for k in range(int(lengths.max(initial=0))):
        some = lengths > k
        full[some] = full[some] * np.uint64(0x9E3779B97F4A7C15) + points[first[some] + k] + np.uint64(7)
    hashes, owners = np.concatenate([*hashes, full]), np.concatenate([*owners, np.arange(len(words))])
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(owners, kind="stable")
    return ((hashes ^ (hashes >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)[order], np.bincount(owners, minlength=len(words))

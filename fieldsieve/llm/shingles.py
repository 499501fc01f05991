"""Word shingles as 64-bit hashes, in numpy inside Spark tasks. A shingle is five words."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SIZE = 5
PUNCTUATION = string.punctuation.encode()
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Texts handled at once: as many as stay under this many bytes, one at least.
SLICE_BYTES = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish (splitmix64), so that order by value is a random order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split(text: str | None, plain: bool = False) -> list[bytes]:
    """Words with A-Z in lower case; bytes know no other upper case and split at ASCII white space only.

    plain: lower case of all scripts, and without ASCII punctuation.
    """
    if not text:
        return []
    return text.lower().encode().translate(None, PUNCTUATION).split() if plain else text.encode().lower().split()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text."""
    for batch in batches:
        sizes = np.cumsum([len(x) if x else 0 for x in batch.column(column).to_pylist()]) if batch.num_rows else np.array([])
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def word_hashes(texts: list[str | None], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more at the end)."""
    lists = [split(t, plain) for t in texts]
    starts = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    return hashed([w for x in lists for w in x]), starts


def hashed(words: list[bytes]) -> np.ndarray:
    """The hash of each word."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    array = np.empty(len(words), dtype=object)
    array[:] = words
    return pd.util.hash_array(array, categorize=True).astype(np.uint64)


def line_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes(texts), and at which words lines begin that have any."""
    words, starts, lines = [], [0], []
    for t in texts:
        for line in (t or "").encode().lower().split(b"\n"):
            if found := line.split():
                lines.append(len(words))
                words += found
        starts.append(len(words))
    return hashed(words), np.array(starts, dtype=np.int64), np.array(lines, dtype=np.int64)


def windows(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The hash of each run of `size` words, at the run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = out * MULTIPLIER + hashes[i : i + n]
    return mixed(out)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; one of all words if they are fewer than five; none without words."""
    hashes, starts = word_hashes(texts)
    every = windows(hashes)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= SIZE:
            yield np.unique(every[a : b - SIZE + 1])
        elif b > a:
            yield windows(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def common(a: bytes, b: bytes) -> int:
    """How many values two packed sorted sets share."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x))

"""A set of hashes as a bitmap of fixed size: no false negatives, and a size that no corpus changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: 8 MB to every task, from at most 2^20 rows.
BITS = 26


def bitmap(df: DataFrame, key: Column) -> np.ndarray:
    """The bitmap of all keys (64-bit hashes). What comes to the driver is bounded by the bitmap, not by df."""
    place = df.select(F.shiftrightunsigned(key, 64 - BITS).alias("p"))
    bits = place.groupBy(F.shiftrightunsigned("p", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    for batch in bits.toArrow().to_batches():
        out[batch.column("slot").to_numpy()] = batch.column("bits").to_numpy()
    return out.view(np.uint64)


def hits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the bitmap has."""
    at = keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - BITS)
    return ((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """What functions.xxhash64 gives for parallel columns of longs without nulls."""
    out = np.uint64(42)
    for c in columns:
        x = c.astype(np.int64).view(np.uint64) * _P2
        h = (out + _P5 + np.uint64(8)) ^ ((x << np.uint64(31) | x >> np.uint64(33)) * _P1)
        h = (h << np.uint64(27) | h >> np.uint64(37)) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out = h ^ (h >> np.uint64(32))
    return out.view(np.int64)

"""Bitmaps of keys: what is sent to every task instead of a long list of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Bits per key, and the bounds of a bitmap (8 KB and 64 MB).
BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
#: Keys above which a bitmap of MOST_BITS would let through more than every eighth stranger.
MOST_KEYS = MOST_BITS // 8
PART_BITS = 15  # of the pieces that Spark builds


def key_hash(column: str = "key") -> Column:
    return F.xxhash64(F.col(column).cast("string"))


def bitmap_of(keys: DataFrame, n: int, column: str = "key") -> np.ndarray:
    """The bits of ``n`` keys as bytes; their number is a power of two.

    Spark sets the bits and joins them in pieces of 4 KB; the driver puts at most
    MOST_BITS of them together.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(n, 1) - 1).bit_length()))
    place = key_hash(column).bitwiseAND(F.lit(bits - 1))
    pieces = keys.groupBy(F.shiftright(place, PART_BITS).cast("int").alias("piece")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << PART_BITS) - 1))).alias("bits"))
    out = np.zeros((bits >> PART_BITS, 1 << (PART_BITS - 3)), dtype=np.uint8)
    for row in pieces.collect():
        out[row["piece"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the bitmap."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

"""A set of hashes as a bitmap of fixed size, small enough to broadcast whatever it stands for.

It never misses a hash that was put in; the fuller it is, the more others it lets through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

BITS = 1 << 27


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bit of each hash, from 1 on as Spark numbers the bits of its bitmaps."""
    return (W.mix(hashes) % np.uint64(size)).astype(np.int64) + 1


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = places(hashes, 8 * len(bits)) - 1
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def gathered(rows: DataFrame, size: int = BITS) -> bytes:
    """The bitmap with the bits ``place`` of all rows; size / 32768 rows of 4 KB reach the driver at most."""
    bucket = F.bitmap_bucket_number("place").alias("bucket")
    parts = rows.groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for bucket, part in parts.collect():
        at = (bucket - 1) * len(part)
        bits[at : at + len(part)] = np.frombuffer(part, np.uint8)
    return bits.tobytes()

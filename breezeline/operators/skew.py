"""Keeping hot keys from landing in one task.

One key may hold a third of all rows. The helpers here find such keys with a
narrow, map-side combined count and hand back a list small enough to broadcast
by proof, not by estimate: a key is hot when it holds more than
``max(SPLIT_ROWS, total / MAX_HOT_KEYS)`` rows, and fewer than MAX_HOT_KEYS
keys can each hold more than that share. The list holds fixed-width digests
instead of keys, so its size in bytes is bounded too (about 2 MB). Two keys
with one digest are merely treated alike; results do not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_ROWS = 1_000_000
MAX_HOT_KEYS = 50_000
# A chunk never spans more arrival numbers than this many times SPLIT_ROWS,
# which bounds its rows even if a key's arrivals are very uneven.
MAX_SPAN = 64
BROADCAST_BYTES = 64 * 1024 * 1024


def key_digest(key: str) -> Column:
    return F.xxhash64(F.col(key))


def hot_keys(
    rows: DataFrame,
    key: str,
    order: str,
    split_rows: int = SPLIT_ROWS,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame | None:
    """``(_digest, _low, _width, _pieces)`` of the keys that hold too many rows.

    None if there are none, so the usual plan stays plain. That is found out
    here, by one job that reads two columns, combines map side and brings two
    numbers back. ``_width`` is the span of arrival numbers that holds about
    ``split_rows`` of the key's rows, ``_pieces`` how many such spans it has.
    """
    counts = rows.groupBy(key_digest(key).alias("_digest")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high")
    )
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if total is None or most <= max(split_rows, total / max_hot):
        return None
    pieces = F.ceil(F.col("_n") / F.lit(split_rows))
    width = F.ceil((F.col("_high") - F.col("_low") + 1) / pieces)
    return counts.where(F.col("_n") > F.lit(max(split_rows, total / max_hot))).select(
        "_digest",
        "_low",
        F.least(width, F.lit(MAX_SPAN * split_rows)).alias("_width"),
        pieces.cast("long").alias("_pieces"),
    )


def with_hot(rows: DataFrame, hot: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Adds ``_low``, ``_width`` and ``_pieces``, NULL for keys that are not hot."""
    listed = F.broadcast(hot)
    return rows.join(listed, key_digest(key) == listed["_digest"], how).drop("_digest")


def fits_broadcast(side: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measures a join side: its rows and text bytes, counted in one job."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in side.dtypes if t == "string"]
    width = sum(texts, F.lit(16 + 16 * len(side.columns)))
    size = side.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]
    return size <= limit


def semi_join(
    rows: DataFrame,
    names: DataFrame,
    key: str,
    order: str,
    split_rows: int = SPLIT_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows whose key is among ``names`` (one column, named like the key).

    The names are broadcast only if they measure small. Otherwise both sides
    shuffle on the key, where a hot key is spread over as many salts as it has
    ``split_rows`` rows and its one name is repeated for each.
    """
    if fits_broadcast(names, broadcast_bytes):
        return rows.join(F.broadcast(names), key, "left_semi").select(*rows.columns)
    hot = hot_keys(rows, key, order, split_rows)
    if hot is None:
        return rows.join(names, key, "left_semi").select(*rows.columns)
    pieces = F.coalesce("_pieces", F.lit(1).cast("long"))
    salted = with_hot(rows, hot, key).withColumn("_salt", F.pmod(F.xxhash64(order), pieces))
    spread = with_hot(names, hot, key).select(
        key, F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("_salt")
    )
    return salted.join(spread, [key, "_salt"], "left_semi").select(*rows.columns)

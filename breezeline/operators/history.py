"""The keep-first history of readings and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import json_number
from ..functions.times import (
    seconds_to_date,
    seconds_to_timestamp,
    storable_seconds,
    timestamp_to_millis,
)
from ..schemas import HISTORY

HISTORY_COLUMNS = [f.name for f in HISTORY.fields]
KEY = ["city", "timestamp"]
MAX_CITY_LENGTH = 64
DEFAULT_LIMIT = 24
MIN_LIMIT = 1
MAX_LIMIT = 1000


def insert_error() -> Column:
    """Why the table refuses a reading, or NULL if it does not."""
    return (
        F.when(F.char_length("city") > MAX_CITY_LENGTH, F.lit(f"city exceeds {MAX_CITY_LENGTH} characters"))
        .when(F.instr("city", "\u0000") > 0, F.lit("city holds a zero character"))
        .when(~storable_seconds(F.col("timestamp")), F.lit("timestamp out of range"))
    )


def storable(readings: DataFrame) -> DataFrame:
    return readings.where(insert_error().isNull())


def insert_rejects(readings: DataFrame) -> DataFrame:
    """Readings the table refuses, with the reason. They are still scored."""
    return readings.withColumn("error", insert_error()).where(F.col("error").isNotNull())


def keep_first(readings: DataFrame) -> DataFrame:
    """The first arrived reading of each (city, timestamp).

    The rank filter also runs before the shuffle, so however often one key
    repeats, each map task sends it once.
    """
    first = W.partitionBy("city", "timestamp").orderBy("seq")
    return (
        readings.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def to_history(readings: DataFrame) -> DataFrame:
    """Readings as history rows, plus the day they are partitioned by."""
    return readings.select(
        *[F.col(c) for c in HISTORY_COLUMNS[:-1]],
        seconds_to_timestamp(F.col("timestamp")).alias("timestamp"),
        seconds_to_date(F.col("timestamp")).alias("date"),
    )


def new_history(readings: DataFrame, existing: DataFrame) -> DataFrame:
    """History rows to append: storable, first of their key, and not yet there.

    Both sides hold a key once, so the anti join has no hot key. ``existing``
    should already be narrowed to the days of the readings.
    """
    return not_yet(first_rows(readings), existing)


def first_rows(readings: DataFrame) -> DataFrame:
    """History rows of readings: storable, first of their key."""
    return to_history(keep_first(storable(readings)))


def not_yet(rows: DataFrame, existing: DataFrame, few: bool = False) -> DataFrame:
    """The history rows whose key is not in ``existing``.

    ``few`` says that the caller has measured the keys of ``rows`` and found
    them small enough to broadcast. Then they go to the stored rows, and the
    taken ones among them, which are no more, come back: no stored row is
    shuffled, however long the history.
    """
    taken = existing.select(*KEY)
    if few:
        taken = F.broadcast(taken.join(F.broadcast(rows.select(*KEY)), KEY, "left_semi"))
    return rows.join(taken, KEY, "left_anti").select(*HISTORY_COLUMNS, "date")


def duplicates(readings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Storable readings whose insert is skipped because their key is taken.

    The kept rows are matched on their arrival number too, which spreads the
    copies of one key over all tasks.
    """
    rows = storable(readings)
    kept = keep_first(rows)
    if existing is not None:
        taken = existing.select("city", F.unix_seconds("timestamp").alias("timestamp"))
        kept = kept.join(taken, ["city", "timestamp"], "left_anti")
    return rows.join(kept.select("city", "timestamp", "seq"), ["city", "timestamp", "seq"], "left_anti")


def check_limit(limit: int) -> int:
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(
            f"Invalid 'limit' parameter, must be between {MIN_LIMIT} and {MAX_LIMIT}"
        )
    return limit


def clamp_limit(limit: int) -> int:
    return max(MIN_LIMIT, min(limit, MAX_LIMIT))


def city_history(
    history: DataFrame, city: str, limit: int = DEFAULT_LIMIT, clamp: bool = False
) -> DataFrame:
    """The latest ``limit`` rows of one city, newest first.

    A limit outside 1..1000 is an error, or with ``clamp`` is moved into range.
    An unknown city gives no rows.
    """
    limit = clamp_limit(limit) if clamp else check_limit(limit)
    return (
        history.where(F.col("city") == city)
        .select(*HISTORY_COLUMNS)
        .orderBy(F.desc("timestamp"))
        .limit(limit)
    )


def latest_history(history: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """:func:`city_history` of every city at once, with its ``rank``.

    Ranked before the shuffle as well, so a hot city sends few rows per task.
    """
    check_limit(limit)
    newest = W.partitionBy("city").orderBy(F.desc("timestamp"))
    return (
        history.select(*HISTORY_COLUMNS)
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= limit)
    )


def history_replies(history: DataFrame) -> DataFrame:
    """Adds ``reply``: the row as JSON, its timestamp in epoch milliseconds.

    Unset fields and those that are NaN are left out of the JSON.
    """
    real = {c for c, kind in history.dtypes if kind == "double"}
    body = F.struct(
        *[json_number(F.col(c)).alias(c) if c in real else F.col(c) for c in HISTORY_COLUMNS[:-1]],
        timestamp_to_millis(F.col("timestamp")).alias("timestamp"),
    )
    return history.withColumn("reply", F.to_json(body))

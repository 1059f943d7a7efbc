"""Current status of a city: its last reading and the average that includes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ema import ema_of_array
from ..functions.messages import unknown_city_text
from ..functions.numbers import json_number
from ..schemas import STATUS
from .rolling import WINDOW_SIZE, check_window

STATUS_COLUMNS = [f.name for f in STATUS.fields]
EARLY_RANK = 1000  # up to this rank Spark filters before the shuffle by itself
SALTS = 64


def _status_columns(last: str, ema: Column) -> list[Column]:
    return [
        F.col("city"),
        F.col(f"{last}.aqi").alias("currentAqi"),
        ema.alias("ema"),
        *[F.col(f"{last}.{c}").alias(c) for c in STATUS_COLUMNS[3:]],
    ]


def latest_reading(readings: DataFrame) -> DataFrame:
    """The last arrived reading of each city (map-side combined)."""
    rest = [c for c in readings.columns if c != "city"]
    return (
        readings.groupBy("city")
        .agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
        .select("city", *[f"_last.{c}" for c in rest])
    )


def known_cities(readings: DataFrame) -> DataFrame:
    """Every city that has sent a reading."""
    return readings.select("city").distinct()


def last_readings(readings: DataFrame, size: int) -> DataFrame:
    """Each city's last ``size`` readings by arrival.

    The rank filter is applied before the shuffle as well as after it, so a hot
    city sends at most ``size`` rows from each map task. Beyond ``EARLY_RANK``
    Spark does not do so; each of ``SALTS`` parts of a city is cut to ``size``
    first, so that no task sorts more than that many times ``size`` rows of one.
    """
    newest = W.partitionBy("city").orderBy(F.desc("seq"))
    if size > EARLY_RANK:
        part = W.partitionBy("city", "_salt").orderBy(F.desc("seq"))
        salted = readings.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)))
        cut = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= size)
        readings = cut.drop("_rank", "_salt")
    return (
        readings.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= size)
        .drop("_rank")
    )


def city_status(readings: DataFrame, city: str | None = None, size: int = WINDOW_SIZE) -> DataFrame:
    """Status of one city (no row if it is unknown) or of every city.

    Only a city's last readings are looked at, so the average is folded once
    per city and not once per reading.
    """
    check_window(size)
    if city is not None:
        readings = readings.where(F.col("city") == city)
    fields = F.struct("seq", "aqi", *STATUS_COLUMNS[3:])
    tails = last_readings(readings, size).groupBy("city").agg(
        F.sort_array(F.collect_list(fields)).alias("_tail")
    )
    return tails.select(
        "city", F.element_at("_tail", -1).alias("_last"), F.col("_tail.aqi").alias("_values")
    ).select(*_status_columns("_last", ema_of_array(F.col("_values"))))


def status_of_scored(scored: DataFrame, city: str | None = None) -> DataFrame:
    """The same from readings that already carry ``ema_after``."""
    if city is not None:
        scored = scored.where(F.col("city") == city)
    fields = F.struct("aqi", "ema_after", *STATUS_COLUMNS[3:])
    return (
        scored.groupBy("city")
        .agg(F.max_by(fields, "seq").alias("_last"))
        .select(*_status_columns("_last", F.col("_last.ema_after")))
    )


def unknown_cities(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested cities that have sent nothing yet."""
    return requested.select("city").distinct().join(known.select("city"), "city", "left_anti")


def status_replies(requested: DataFrame, status: DataFrame) -> DataFrame:
    """``(city, found, reply)``: status JSON per requested city, or an error JSON.

    Unset fields and those that are NaN are left out of the JSON.
    """
    real = {c for c, kind in status.dtypes if kind == "double"}
    body = F.struct(*[json_number(F.col(c)).alias(c) if c in real else F.col(c) for c in STATUS_COLUMNS])
    found = F.col("currentAqi").isNotNull()
    error = F.struct(unknown_city_text(F.col("city")).alias("error"))
    return (
        requested.select("city")
        .distinct()
        .join(status, "city", "left")
        .select(
            "city",
            found.alias("found"),
            F.when(found, F.to_json(body)).otherwise(F.to_json(error)).alias("reply"),
        )
    )

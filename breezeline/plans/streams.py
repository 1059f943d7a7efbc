"""Queries that run the streaming jobs over the given tables.

The input is landed in a few slices of arrival order. After each the job runs
until it has caught up and stops, so every run but the first restarts from the
checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import messages
from ..schemas import MEASUREMENT, RESPONSE
from ..session import work_dir
from ..sources import responses as response_source
from ..sources import tables, topic
from ..sources.registry_store import RegistryStore
from ..streaming import monitor, poller
from . import inputs

SLICES = 2


def slices(rows: DataFrame, count: int = SLICES) -> list[DataFrame]:
    """Consecutive parts of the arrival order that together hold every row."""
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    number = F.floor((F.col("seq") - F.lit(low)) * count / F.lit(high - low + 1))
    return [rows.where(number == i) for i in range(count)]


def monitored(spark: SparkSession, rows: DataFrame, land: Callable[[DataFrame, str], None]) -> str:
    """Runs the monitor over rows landed slice by slice; returns its folder."""
    root = work_dir(spark)
    landing = f"{root}/topic"
    for part in slices(rows):
        land(part, landing)
        records = topic.stream_files(spark, landing)
        monitor.run_monitor(records, f"{root}/monitor").awaitTermination()
    return f"{root}/monitor"


def _land_readings(part: DataFrame, path: str) -> None:
    topic.write_files(part, path)


def _land_records(part: DataFrame, path: str) -> None:
    part.write.mode("append").parquet(path)


def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = monitored(spark, inputs.readings(spark, sf_dir), _land_readings)
    return monitor.read_outcomes(spark, root).select(
        "seq", "city", "aqi", "ema_before", "position", "outcome", "details"
    )


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = monitored(spark, inputs.daily_readings(spark, sf_dir), _land_readings)
    history = tables.read_history(spark, monitor.Tables(root).history)
    return history.select(
        *H.HISTORY_COLUMNS[:-1], F.unix_seconds("timestamp").alias("timestamp")
    )


def stream_history_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One city's latest rows, looked up in the newest days of the monitor's history."""
    root = monitored(spark, inputs.daily_readings(spark, sf_dir), _land_readings)
    history = tables.city_history(spark, monitor.Tables(root).history, inputs.CITY)
    return history.select(*H.HISTORY_COLUMNS[:-1], F.unix_seconds("timestamp").alias("timestamp"))


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = monitored(spark, inputs.readings(spark, sf_dir), _land_readings)
    return monitor.status_now(spark, root)


def stream_status_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One city's status, looked up in the state of the stream."""
    root = monitored(spark, inputs.readings(spark, sf_dir), _land_readings)
    return monitor.status_now(spark, root, inputs.CITY)


def stream_repeated_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a topic whose publisher sends every slice twice, and the second one with the third."""
    root = work_dir(spark)
    parts = slices(inputs.readings(spark, sf_dir), 3)
    for sent in ((0, 0), (0, 1), (1, 2, 2)):
        for number in sent:
            topic.write_files(parts[number], f"{root}/topic")
        records = topic.stream_files(spark, f"{root}/topic")
        monitor.run_monitor(records, f"{root}/monitor").awaitTermination()
    return monitor.read_outcomes(spark, f"{root}/monitor").select(
        "seq", "city", "aqi", "ema_before", "position", "outcome", "details"
    )


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records, set aside while the stream goes on."""
    root = monitored(spark, inputs.records(spark, sf_dir), _land_records)
    return monitor.read_rejects(spark, root).select("seq", "key", "value")


def _polled(spark: SparkSession, sf_dir: str) -> str:
    root = work_dir(spark)
    landing = f"{root}/landed"
    rows = inputs.responses(spark, sf_dir).select(*RESPONSE.names)
    for part in slices(rows):
        part.write.mode("append").parquet(landing)
        landed = response_source.stream_responses(spark, landing, "parquet")
        poller.run_poller(
            landed, f"{root}/poller", lambda session: inputs.registry(session, sf_dir)
        ).awaitTermination()
    return f"{root}/poller"


def stream_poll_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings published from responses of cities valid at the time."""
    records = topic.read_files(spark, f"{_polled(spark, sf_dir)}/topic")
    return messages.readings(messages.decode(records)).select(*MEASUREMENT.names)


def stream_poll_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poller.read_invalid(spark, _polled(spark, sf_dir)).select("name", "rows_affected", "error")


ENABLED_BEFORE = 2  # the slice before which every other city is enabled again


def _versioned(spark: SparkSession, sf_dir: str) -> str:
    """Three polls over a versioned registry; before the last, cities of even number found unknown are enabled again."""
    root = work_dir(spark)
    landing, out = f"{root}/landed", f"{root}/poller"
    store = RegistryStore(spark, f"{root}/registry")
    store.create(inputs.registry(spark, sf_dir))
    rows = inputs.responses(spark, sf_dir).select(*RESPONSE.names)
    for number, part in enumerate(slices(rows, 3)):
        if number == ENABLED_BEFORE:
            again = poller.read_invalid(spark, out).where("cast(name as long) % 2 = 0")
            store.change(again.select("name", F.lit(True).alias("valid_entry")))
        part.write.mode("append").parquet(landing)
        landed = response_source.stream_responses(spark, landing, "parquet")
        poller.run_poller(landed, out, store).awaitTermination()
    return out


def stream_registry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings published while the registry changes, cities enabled again among them."""
    records = topic.read_files(spark, f"{_versioned(spark, sf_dir)}/topic")
    return messages.readings(messages.decode(records)).select(*MEASUREMENT.names)


def stream_registry_reloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each poll of a changing registry found: counts before and now, and the entries it made invalid."""
    reloads = poller.read_reloads(spark, _versioned(spark, sf_dir))
    return reloads.select("batch_id", "old_count", "new_count", "change", "label", "rows_affected")

"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import history as H
from ..operators import messages, registry, responses, scoring, status
from ..schemas import HISTORY, STATUS
from ..session import work_dir
from ..sources.registry import read_seed
from . import inputs, streams

Query = Callable[[SparkSession, str], DataFrame]

CITY = inputs.CITY
# Rows per chunk for the variants that cut every city as if it were hot.
SMALL_CHUNK = 10
ALERT_COLUMNS = ["seq", "city", "aqi", "ema_before", "alert_type", "details"]
OUTCOME_COLUMNS = ["seq", "city", "aqi", "ema_before", "position", "outcome", "details"]


def _scored(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return scoring.score(inputs.readings(spark, sf_dir), **kw)


def _in_seconds(rows: DataFrame, *columns: str) -> DataFrame:
    """History rows with epoch seconds, the same in every session time zone."""
    return rows.select(*H.HISTORY_COLUMNS[:-1], F.unix_seconds("timestamp").alias("timestamp"), *columns)


def _empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HISTORY)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.new_history(inputs.readings(spark, sf_dir), _empty_history(spark))


def _error_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History that already holds the days on which a city sent an error event."""
    errors = inputs.table(spark, sf_dir, "events").where("event_type = 'error'")
    days = errors.select(
        F.col("user_id").cast("string").alias("city"),
        (F.floor(times.ntz_to_seconds(F.col("ts")) / inputs.DAY) * inputs.DAY).alias("timestamp"),
    ).distinct()
    return days.select("city", times.seconds_to_timestamp(F.col("timestamp")).alias("timestamp"))


# -- scoring


def rolling_ema(spark, sf_dir):
    return _scored(spark, sf_dir).select("seq", "city", "aqi", "ema_before", "ema_after")


def rolling_ema_hot_keys(spark, sf_dir):
    """As rolling_ema, with every city cut into chunks of arrivals."""
    scored = _scored(spark, sf_dir, split_rows=SMALL_CHUNK)
    return scored.select("seq", "city", "aqi", "ema_before", "ema_after")


def rolling_ema_wide(spark, sf_dir):
    """A window of 40 values, which takes the array form."""
    return _scored(spark, sf_dir, size=40).select("seq", "city", "aqi", "ema_before", "ema_after")


def alerts(spark, sf_dir):
    return scoring.alerts(_scored(spark, sf_dir)).select(*ALERT_COLUMNS)


def outcomes(spark, sf_dir):
    return scoring.outcomes(_scored(spark, sf_dir)).select(*OUTCOME_COLUMNS)


def alerts_other_limits(spark, sf_dir):
    scored = _scored(spark, sf_dir, size=3)
    return scoring.alerts(scored, threshold=80, multiplier=2.0).select(*ALERT_COLUMNS)


# -- status


def city_status(spark, sf_dir):
    return status.city_status(inputs.readings(spark, sf_dir))


def city_status_wide(spark, sf_dir):
    """Averages over more values than Spark cuts to before a shuffle by itself."""
    return status.city_status(inputs.readings(spark, sf_dir), size=1500)


def status_of_scored(spark, sf_dir):
    return status.status_of_scored(_scored(spark, sf_dir))


def status_one(spark, sf_dir):
    return status.city_status(inputs.readings(spark, sf_dir), CITY)


def status_unknown_city(spark, sf_dir):
    return status.city_status(inputs.readings(spark, sf_dir), "no such city")


def latest_reading(spark, sf_dir):
    return status.latest_reading(inputs.readings(spark, sf_dir))


def known_cities(spark, sf_dir):
    return status.known_cities(inputs.readings(spark, sf_dir))


def _requested(spark, sf_dir):
    return inputs.registry(spark, sf_dir).select(F.col("name").alias("city"))


def unknown_cities(spark, sf_dir):
    known = status.known_cities(inputs.readings(spark, sf_dir))
    return status.unknown_cities(_requested(spark, sf_dir), known)


def status_replies(spark, sf_dir):
    """Replies for every registry city, read back from their JSON."""
    current = status.city_status(inputs.readings(spark, sf_dir))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STATUS.fields[1:])
    return (
        status.status_replies(_requested(spark, sf_dir), current)
        .withColumn("r", F.from_json("reply", f"{shape}, error string"))
        .select("city", "found", *[f"r.{f.name}" for f in STATUS.fields[1:]], "r.error")
    )


# -- history


def history_keep_first(spark, sf_dir):
    kept = H.keep_first(H.storable(inputs.daily_readings(spark, sf_dir)))
    return kept.select("seq", "city", "aqi", "pm25", "timestamp")


def history_append(spark, sf_dir):
    """Readings that a history with some of their days still takes in."""
    existing = _error_history(spark, sf_dir)
    return _in_seconds(H.new_history(inputs.daily_readings(spark, sf_dir), existing))


def history_duplicates(spark, sf_dir):
    rows = inputs.daily_readings(spark, sf_dir)
    return H.duplicates(rows, _error_history(spark, sf_dir)).select("seq", "city", "timestamp")


def history_insert_rejects(spark, sf_dir):
    """City names as long as the reading is high; long ones do not fit."""
    name = F.concat("city", F.repeat(F.lit("x"), F.col("aqi")))
    rows = inputs.readings(spark, sf_dir).withColumn("city", name)
    return H.insert_rejects(rows).select("seq", "city", "aqi", "error")


def history_rows(spark, sf_dir):
    """Readings as history rows, with day and epoch milliseconds."""
    rows = H.to_history(inputs.readings(spark, sf_dir))
    return _in_seconds(
        rows,
        F.col("date").cast("string").alias("day"),
        times.timestamp_to_millis(F.col("timestamp")).alias("millis"),
    )


def history_topk(spark, sf_dir):
    return _in_seconds(H.latest_history(_history(spark, sf_dir), 24), "rank")


def history_one(spark, sf_dir):
    return _in_seconds(H.city_history(_history(spark, sf_dir), CITY))


def history_one_clamped(spark, sf_dir):
    """A limit of 0 counts as 1 here, where the strict lookup refuses it."""
    return _in_seconds(H.city_history(_history(spark, sf_dir), CITY, 0, clamp=True))


def history_replies(spark, sf_dir):
    """Reply JSON of every history row, read back."""
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HISTORY.fields[:-1])
    return (
        H.history_replies(_history(spark, sf_dir))
        .select(F.from_json("reply", f"{shape}, timestamp bigint").alias("r"))
        .select("r.*")
    )


def time_conversions(spark, sf_dir):
    """Seconds to instants, to milliseconds and back."""
    rows = inputs.readings(spark, sf_dir)
    at = times.seconds_to_timestamp(F.col("timestamp"))
    millis = times.timestamp_to_millis(at)
    return rows.select(
        "seq",
        millis.alias("millis"),
        F.unix_seconds(times.millis_to_timestamp(millis)).alias("seconds"),
        times.seconds_to_date(F.col("timestamp")).cast("string").alias("day"),
    )


# -- responses


def _classified(spark, sf_dir):
    return responses.classify(inputs.responses(spark, sf_dir))


def response_ladder(spark, sf_dir):
    return _classified(spark, sf_dir).select("seq", "city", "error", "invalidates")


def response_events(spark, sf_dir):
    return responses.events(_classified(spark, sf_dir))


def response_rejects(spark, sf_dir):
    return responses.rejects(_classified(spark, sf_dir))


def response_invalid_cities(spark, sf_dir):
    return responses.invalid_cities(_classified(spark, sf_dir))


# -- registry


def registry_valid(spark, sf_dir):
    return registry.valid_cities_by_name(inputs.registry(spark, sf_dir))


def registry_semi_join(spark, sf_dir):
    rows = registry.of_valid_cities(
        inputs.readings(spark, sf_dir), inputs.registry(spark, sf_dir)
    )
    return rows.select("seq", "city", "aqi")


def registry_semi_join_salted(spark, sf_dir):
    """The same with the registry taken as too large to broadcast."""
    rows = registry.of_valid_cities(
        inputs.readings(spark, sf_dir),
        inputs.registry(spark, sf_dir),
        split_rows=SMALL_CHUNK,
        broadcast_bytes=0,
    )
    return rows.select("seq", "city", "aqi")


def _invalid_names(spark, sf_dir):
    """Cities with an unknown station, and suppliers, which are no cities."""
    suppliers = inputs.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return responses.invalid_cities(_classified(spark, sf_dir)).unionByName(suppliers)


def registry_invalidate(spark, sf_dir):
    return registry.mark_invalid(inputs.registry(spark, sf_dir), _invalid_names(spark, sf_dir))


def registry_invalidation_report(spark, sf_dir):
    return registry.invalidation_report(
        inputs.registry(spark, sf_dir), _invalid_names(spark, sf_dir)
    )


def registry_seed_insert(spark, sf_dir):
    rows = registry.insert_seed(inputs.registry(spark, sf_dir), inputs.seed(spark, sf_dir))
    return rows.drop("created_at")


def registry_seed_files(spark, sf_dir):
    """Seed rows from several CSV files: the first of a repeated name wins, by file and line."""
    path = f"{work_dir(spark)}/seed"
    rows = inputs.supplier_seed(spark, sf_dir).repartitionByRange(4, "position").sortWithinPartitions("position")
    rows.drop("position").write.option("header", True).csv(path)
    added = registry.insert_seed(inputs.registry(spark, sf_dir), read_seed(spark, path))
    return added.drop("created_at")


def registry_reload(spark, sf_dir):
    old = inputs.registry(spark, sf_dir)
    return registry.reload_summary(old, registry.mark_invalid(old, _invalid_names(spark, sf_dir)))


def _flags(df):
    return df.select("name", "valid_entry", F.unix_seconds("flag_at").alias("flag_at"))


def registry_newest_flags(spark, sf_dir):
    """Flags after all changes, the newest of them winning over older flags."""
    changes = registry.newest_flags(inputs.flag_changes(spark, sf_dir))
    return _flags(registry.apply_flags(inputs.dated_registry(spark, sf_dir), changes))


def registry_merge(spark, sf_dir):
    """A reload merged with flags that the stream has changed in the meantime."""
    stored = registry.newest_flags(inputs.flag_changes(spark, sf_dir))
    half = inputs.dated_registry(spark, sf_dir).where("id % 2 = 0")
    return _flags(registry.merge_registry(stored, half))


# -- topic


def topic_round_trip(spark, sf_dir):
    return messages.readings(messages.decode(messages.encode(inputs.readings(spark, sf_dir))))


def topic_decode(spark, sf_dir):
    return messages.readings(messages.decode(inputs.records(spark, sf_dir)))


def topic_rejects(spark, sf_dir):
    return messages.undecodable(messages.decode(inputs.records(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        rolling_ema,
        rolling_ema_hot_keys,
        rolling_ema_wide,
        alerts,
        outcomes,
        alerts_other_limits,
        city_status,
        city_status_wide,
        status_of_scored,
        status_one,
        status_unknown_city,
        latest_reading,
        known_cities,
        unknown_cities,
        status_replies,
        history_keep_first,
        history_append,
        history_duplicates,
        history_insert_rejects,
        history_rows,
        history_topk,
        history_one,
        history_one_clamped,
        history_replies,
        time_conversions,
        response_ladder,
        response_events,
        response_rejects,
        response_invalid_cities,
        registry_valid,
        registry_semi_join,
        registry_semi_join_salted,
        registry_invalidate,
        registry_invalidation_report,
        registry_seed_insert,
        registry_seed_files,
        registry_reload,
        registry_newest_flags,
        registry_merge,
        topic_round_trip,
        topic_decode,
        topic_rejects,
        streams.stream_outcomes,
        streams.stream_history,
        streams.stream_history_one,
        streams.stream_status,
        streams.stream_status_one,
        streams.stream_repeated_outcomes,
        streams.stream_rejects,
        streams.stream_poll_events,
        streams.stream_poll_invalid,
        streams.stream_registry_events,
        streams.stream_registry_reloads,
    )
}

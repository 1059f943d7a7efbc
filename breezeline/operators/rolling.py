"""Each reading together with the moving average of its city's last values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ema import ema_of_array, ema_of_columns, last_of_array, weight_of
from .skew import SPLIT_ROWS, hot_keys, with_hot

WINDOW_SIZE = 10
# Up to this size the last values travel as columns inside generated code;
# beyond it as an array.
MAX_COLUMNS = 16
BEFORE_ALL = -1


def check_window(size: int) -> None:
    if size < 1:
        raise ValueError("window size must be at least 1")


def _chunked(rows: DataFrame) -> DataFrame:
    """Adds ``_chunk``: 0 for an ordinary city, a span of arrivals for a hot one."""
    span = F.expr("(seq - _low) div _width")
    chunk = F.when(F.col("_width").isNull(), F.lit(0)).otherwise(span)
    return rows.withColumn("_chunk", chunk.cast("long")).drop("_low", "_width", "_pieces")


def _in_chunk(rows: DataFrame, chunk: int) -> DataFrame:
    return rows.drop("_low", "_width", "_pieces").withColumn("_chunk", F.lit(chunk).cast("long"))


def _lead_in(tails: DataFrame, size: int) -> DataFrame:
    """For each chunk of a hot city, the values that came just before it.

    Every chunk is first cut to its own last values, map side, so only a few
    values per chunk are shuffled; one city's chunks are few.
    """
    newest = W.partitionBy("city", "_chunk").orderBy(F.desc("seq"))
    per_chunk = (
        tails.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= size)
        .groupBy("city", "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "aqi")))["aqi"].alias("_tail"))
    )
    # every chunk holds at least one value, so `size` chunks always suffice
    earlier = W.partitionBy("city").orderBy("_chunk").rowsBetween(-size, -1)
    return (
        per_chunk.withColumn("_tails", F.collect_list("_tail").over(earlier))
        .where(F.col("_chunk") > BEFORE_ALL)
        .withColumn("_values", F.flatten("_tails"))
        .select("city", "_chunk", F.posexplode(last_of_array(F.col("_values"), size)))
        .select("city", "_chunk", F.col("pos").cast("long").alias("seq"), F.col("col").alias("aqi"))
    )


def _split(
    readings: DataFrame, carried: DataFrame | None, hot: DataFrame, size: int
) -> tuple[DataFrame, list[DataFrame]]:
    """Readings with their chunk, and the earlier values each chunk needs."""
    narrow = readings.select("city", "seq", "aqi").where("aqi is not null")
    tails = _chunked(with_hot(narrow, hot, "city", "inner"))
    earlier = []
    if carried is not None:
        listed = with_hot(carried, hot, "city")
        is_hot = F.col("_width").isNotNull()
        tails = tails.unionByName(_in_chunk(listed.where(is_hot), BEFORE_ALL))
        earlier.append(_in_chunk(listed.where(~is_hot), 0))
    earlier.append(_lead_in(tails, size))
    return _chunked(with_hot(readings, hot, "city")), earlier


def rolling_ema(
    readings: DataFrame,
    size: int = WINDOW_SIZE,
    carried: DataFrame | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Adds ``ema_before`` and ``ema_after`` over a city's last values.

    ``ema_before`` covers the up to ``size`` values before the reading (NULL
    for a city's first), ``ema_after`` those up to and including it. Order is
    arrival order, ``seq``; no timestamp is looked at. A reading whose ``aqi`` is
    NULL has NULL averages and takes no part in those of others.

    ``carried`` holds ``(city, seq, aqi)`` of values that came before all of
    ``readings``; they feed the averages but do not come out.

    Whole rows shuffle once, on the city. Where some city is hot, the shuffle
    is on city and chunk: a hot city is cut into spans of arrivals, each
    preceded by copies of the last values before it, so that no task holds a
    whole hot city and every average still sees the values it needs.
    """
    check_window(size)
    columns = readings.columns
    hot = hot_keys(readings, "city", "seq", split_rows)
    if carried is not None:
        carried = carried.select("city", F.col("seq").cast("long"), "aqi").where("aqi is not null")
    if hot is None:
        group, rows = ["city"], readings
        earlier = [] if carried is None else [carried]
    else:
        group = ["city", "_chunk"]
        rows, earlier = _split(readings, carried, hot, size)

    # earlier values sort before the readings, whatever their numbers
    rows = rows.withColumn("_live", F.lit(True))
    for part in earlier:
        rows = rows.unionByName(part.withColumn("_live", F.lit(False)), allowMissingColumns=True)
    rows = rows.withColumn("_void", F.col("aqi").isNull())
    arrivals = W.partitionBy(*group, "_void").orderBy("_live", "seq")
    averaged = (_by_columns if size <= MAX_COLUMNS else _by_array)(rows, arrivals, size)
    averages = [F.when(~F.col("_void"), F.col(c)).alias(c) for c in ("ema_before", "ema_after")]
    return averaged.where("_live").select(*columns, *averages)


def _by_columns(rows: DataFrame, arrivals, size: int) -> DataFrame:
    before = [F.col(f"_v{k}") for k in range(1, size + 1)]
    seen = F.row_number().over(arrivals)
    n_before, n_after = F.col("_n_before"), F.col("_n_after")
    return (
        rows.select(
            "*",
            *[F.lag("aqi", k).over(arrivals).alias(f"_v{k}") for k in range(1, size + 1)],
            seen.alias("_seen"),
        )
        .withColumns(
            {
                "_n_before": F.least(F.col("_seen") - 1, F.lit(size)),
                "_n_after": F.least("_seen", F.lit(size)),
            }
        )
        .withColumns({"_w_before": weight_of(n_before), "_w_after": weight_of(n_after)})
        .withColumns(
            {
                "ema_before": ema_of_columns(before, n_before, F.col("_w_before")),
                "ema_after": ema_of_columns(
                    [F.col("aqi"), *before[: size - 1]], n_after, F.col("_w_after")
                ),
            }
        )
    )


def _by_array(rows: DataFrame, arrivals, size: int) -> DataFrame:
    frame = arrivals.rowsBetween(-size, -1)
    return (
        rows.withColumn("_before", F.collect_list("aqi").over(frame))
        .withColumn("_after", last_of_array(F.array_append("_before", F.col("aqi")), size))
        .withColumn("ema_before", ema_of_array(F.col("_before")))
        .withColumn("ema_after", ema_of_array(F.col("_after")))
    )

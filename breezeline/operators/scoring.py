"""Alerts and outcomes of scored readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import normal_text, spike_text, unhealthy_text
from .rolling import WINDOW_SIZE, rolling_ema
from .skew import SPLIT_ROWS

UNHEALTHY_THRESHOLD = 150
SPIKE_MULTIPLIER = 1.3

UNHEALTHY = "UNHEALTHY"
SPIKE = "SPIKE"
NORMAL = "NORMAL"


def score(
    readings: DataFrame,
    size: int = WINDOW_SIZE,
    carried: DataFrame | None = None,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Readings with ``ema_before`` (the alert baseline) and ``ema_after``."""
    return rolling_ema(readings, size, carried, split_rows)


def is_unhealthy(threshold: int = UNHEALTHY_THRESHOLD) -> Column:
    return F.col("aqi") > F.lit(threshold)


def spike_limit(multiplier: float = SPIKE_MULTIPLIER) -> Column:
    return F.col("ema_before") * F.lit(float(multiplier))


def is_spike(multiplier: float = SPIKE_MULTIPLIER) -> Column:
    """False, not NULL, where there is no baseline yet."""
    return F.coalesce(F.col("aqi") > spike_limit(multiplier), F.lit(False))


def outcomes(
    scored: DataFrame,
    threshold: int = UNHEALTHY_THRESHOLD,
    multiplier: float = SPIKE_MULTIPLIER,
    normal: bool = True,
) -> DataFrame:
    """One or two rows per reading: UNHEALTHY, then SPIKE, or else NORMAL.

    ``position`` orders the rows of one reading. One pass over the scored rows;
    with ``normal=False`` readings without an alert give no row.
    """
    c = F.col
    unhealthy, spike = is_unhealthy(threshold), is_spike(multiplier)
    raised = [
        F.when(
            unhealthy,
            F.struct(
                F.lit(UNHEALTHY).alias("outcome"),
                unhealthy_text(c("city"), c("aqi"), threshold, c("pm25"), c("pm10")).alias("details"),
            ),
        ),
        F.when(
            spike,
            F.struct(
                F.lit(SPIKE).alias("outcome"),
                spike_text(c("city"), c("aqi"), c("ema_before"), spike_limit(multiplier)).alias(
                    "details"
                ),
            ),
        ),
    ]
    if normal:
        raised.append(
            F.when(
                ~unhealthy & ~spike,
                F.struct(
                    F.lit(NORMAL).alias("outcome"),
                    normal_text(c("city"), c("aqi"), c("ema_before"), c("temperature")).alias(
                        "details"
                    ),
                ),
            )
        )
    else:
        scored = scored.where(unhealthy | spike)
    return scored.select(
        "seq",
        "city",
        "timestamp",
        "aqi",
        "ema_before",
        F.posexplode(F.array_compact(F.array(*raised))).alias("position", "raised"),
    ).select(
        "seq", "city", "timestamp", "aqi", "ema_before", "position", "raised.outcome", "raised.details"
    )


def alerts(
    scored: DataFrame,
    threshold: int = UNHEALTHY_THRESHOLD,
    multiplier: float = SPIKE_MULTIPLIER,
) -> DataFrame:
    """The UNHEALTHY and SPIKE rows of :func:`outcomes`."""
    return outcomes(scored, threshold, multiplier, normal=False).withColumnRenamed(
        "outcome", "alert_type"
    )

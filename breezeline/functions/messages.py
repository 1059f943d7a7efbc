"""Texts of scoring outcomes and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import percent_increase, truncated_int


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def unhealthy_text(city: Column, aqi: Column, threshold: int, pm25: Column, pm10: Column) -> Column:
    return _text(
        "[", city, "] ALERT 1: Unhealthy AQI! Value: ", aqi,
        f" (threshold: {threshold}) | PM2.5: ", pm25, ", PM10: ", pm10,
    )


def spike_text(city: Column, aqi: Column, ema: Column, limit: Column) -> Column:
    return _text(
        "[", city, "] ALERT 2: Sudden spike! Current: ", aqi,
        " vs EMA: ", truncated_int(ema),
        " (+", percent_increase(aqi, ema), "%, threshold: ", truncated_int(limit), ")",
    )


def normal_text(city: Column, aqi: Column, ema: Column, temperature: Column) -> Column:
    shown = F.coalesce(truncated_int(ema).cast("string"), F.lit("N/A"))
    return _text("[", city, "] AQI: ", aqi, " (EMA: ", shown, ", T: ", temperature, "°C)")


def unknown_city_text(city: Column) -> Column:
    return _text("City '", city, "' not found or no data yet")

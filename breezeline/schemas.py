"""Declared row shapes. Nothing in the library is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# A reading, in the order of its fields on the topic.
READING = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("aqi", T.IntegerType()),
        T.StructField("co", T.DoubleType()),
        T.StructField("no2", T.DoubleType()),
        T.StructField("pm10", T.DoubleType()),
        T.StructField("pm25", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

# A reading with its arrival number, which is unique and increasing per city.
MEASUREMENT = T.StructType([T.StructField("seq", T.LongType()), *READING.fields])

RESPONSE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("city", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)

TOPIC_RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("continent", T.StringType()),
        T.StructField("valid_entry", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

SEED = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("continent", T.StringType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("aqi", T.IntegerType()),
        T.StructField("co", T.DoubleType()),
        T.StructField("no2", T.DoubleType()),
        T.StructField("pm10", T.DoubleType()),
        T.StructField("pm25", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

STATUS = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("currentAqi", T.IntegerType()),
        T.StructField("ema", T.DoubleType()),
        T.StructField("co", T.DoubleType()),
        T.StructField("no2", T.DoubleType()),
        T.StructField("pm10", T.DoubleType()),
        T.StructField("pm25", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

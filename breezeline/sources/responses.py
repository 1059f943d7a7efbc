"""Landed API responses: one row per city and poll, written by any fetcher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import RESPONSE


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(RESPONSE).format(fmt).load(path)


def stream_responses(
    spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None
) -> DataFrame:
    """Files are taken in order of modification time."""
    reader = spark.readStream.schema(RESPONSE).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)

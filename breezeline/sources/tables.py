"""Result tables, written so that repeating a batch changes nothing.

Each micro-batch owns the ``batch_id=<n>`` part of a table and overwrites it.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import history as H
from ..schemas import HISTORY
from . import files

LISTED_DAYS = 1000  # distinct days of a batch that are named in the plan; of more, the first and the last
BROADCAST_BYTES = 64 << 20  # keys of a batch beyond this are joined by a shuffle
ROW_BYTES = 64  # what a broadcast key takes besides its city

BATCH = T.StructField("batch_id", T.LongType())
HISTORY_TABLE = T.StructType([*HISTORY.fields, T.StructField("date", T.DateType()), BATCH])


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of a table, with their ``batch_id``."""
    return spark.read.schema(T.StructType([*schema.fields, BATCH])).parquet(path)


def create_table(spark: SparkSession, path: str, schema: T.StructType, parts: list[str]) -> None:
    """Makes the table readable before its first row; an existing one is kept."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*parts).parquet(path)


def create_history(spark: SparkSession, path: str) -> None:
    create_table(spark, path, HISTORY_TABLE, ["date", "batch_id"])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_TABLE).parquet(path)


def append_history(readings: DataFrame, path: str, batch_id: int) -> None:
    """Appends the readings whose (city, timestamp) is new.

    Only the days of the readings are read from the table, and only what
    earlier batches wrote, so a repeated batch writes the same rows to the same
    place. The stored rows are not shuffled if the keys of the batch can be
    broadcast, which is measured first. One writer at a time.
    """
    spark = readings.sparkSession
    rows = H.first_rows(readings).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size, first, last = rows.agg(
            F.sum(F.octet_length("city") + ROW_BYTES), F.min(F.unix_date("date")), F.max(F.unix_date("date"))
        ).first()
        if first is None:
            return
        days = rows.select(F.unix_date("date")).where("date is not null").distinct().limit(LISTED_DAYS + 1).collect()
        earlier = read_history(spark, path).where(F.col("batch_id") < batch_id)
        if len(days) <= LISTED_DAYS:  # literals, so that other days' files are not opened
            earlier = earlier.where(F.col("date").isin(*(_date(n) for (n,) in days)))
        else:
            earlier = earlier.where(F.col("date").between(_date(first), _date(last)))
        (
            H.not_yet(rows, earlier, size <= BROADCAST_BYTES)
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            # even files per day, however many readings one day has
            .hint("rebalance", "date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date", "batch_id")
            .parquet(path)
        )
    finally:
        rows.unpersist()


def _date(number: int):
    return F.date_from_unix_date(F.lit(number))


def _day_order(name: str) -> tuple:
    """Sorts folders of days by date, those without a date first."""
    found = re.fullmatch(r"date=([+-]?[0-9]+)-([0-9]+)-([0-9]+)", name)
    return (found is not None, *map(int, found.groups() if found else ()))


def city_history(
    spark: SparkSession, path: str, city: str, limit: int = H.DEFAULT_LIMIT, clamp: bool = False
) -> DataFrame:
    """:func:`H.city_history` of a stored history, which opens its newest days only.

    Days are walked from the newest back, each step as many as all steps before,
    until ``limit`` rows of the city are found; older rows cannot be among the
    latest. A city with fewer rows is looked for in all days.
    """
    limit = H.clamp_limit(limit) if clamp else H.check_limit(limit)
    days = sorted((n for n in files.names(spark, path) if n.startswith("date=")), key=_day_order, reverse=True)

    def of(some: list[str]) -> DataFrame:
        reader = spark.read.schema(HISTORY_TABLE).option("basePath", path)
        return reader.parquet(*(f"{path}/{day}" for day in some)).where(F.col("city") == city)

    found = taken = 0
    while found < limit and taken < len(days):
        step = days[taken : 2 * taken or 1]
        found += of(step).select("city").limit(limit - found).count()
        taken += len(step)
    rows = of(days[:taken]) if days else spark.createDataFrame([], HISTORY)
    return H.city_history(rows, city, limit)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has ended well."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)

"""The registry as a table snapshot, a database table or a seed file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import REGISTRY_COLUMNS
from ..schemas import REGISTRY, SEED


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(path)


def read_registry_jdbc(spark: SparkSession, url: str, table: str = "cities", **options) -> DataFrame:
    """From a database; filters and the column list are pushed down to it.

    Needs the database's driver on the class path.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return reader.options(**options).load().select(*REGISTRY_COLUMNS)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """CSV files ``name,country,continent`` with a header, in the order of their names.

    ``position`` orders the rows as they are in the files, however Spark splits
    and gathers these, so that the first of a repeated name wins.
    """
    rows = spark.read.schema(SEED).option("header", True).csv(path)
    # rows of one block are read by one task, one after the other
    place = F.monotonically_increasing_id().alias("place")
    return rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", place).alias("position"))


def write_registry(registry: DataFrame, path: str) -> None:
    """A new snapshot. ``path`` must not be the one the registry is read from."""
    registry.select(*REGISTRY_COLUMNS).write.mode("overwrite").parquet(path)

"""The monitor: topic records in; scores, outcomes, status and history out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.ema import ema_of_array
from ..operators import history as H
from ..operators import messages, scoring
from ..operators.rolling import WINDOW_SIZE, check_window
from ..operators.skew import SPLIT_ROWS
from ..operators.status import STATUS_COLUMNS
from ..schemas import MEASUREMENT, STATUS, TOPIC_RECORD
from ..session import adaptive
from ..sources import files, tables
from .carry import CARRY, carried_values, new_readings, read_state

SCORED = T.StructType(
    [
        *MEASUREMENT.fields,
        T.StructField("ema_before", T.DoubleType()),
        T.StructField("ema_after", T.DoubleType()),
    ]
)
OUTCOME = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("city", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("aqi", T.IntegerType()),
        T.StructField("ema_before", T.DoubleType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("details", T.StringType()),
    ]
)
REJECT = T.StructType([*TOPIC_RECORD.fields])
INSERT_REJECT = T.StructType([*MEASUREMENT.fields, T.StructField("error", T.StringType())])


@dataclass(frozen=True)
class Tables:
    """Where a monitor writes, all below one folder."""

    root: str

    @property
    def scored(self) -> str:
        return f"{self.root}/scored"

    @property
    def outcomes(self) -> str:
        return f"{self.root}/outcomes"

    @property
    def history(self) -> str:
        return f"{self.root}/history"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def insert_rejects(self) -> str:
        return f"{self.root}/insert_rejects"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def monitored(records: DataFrame, size: int) -> DataFrame:
    """One stream of decoded records and, per micro-batch, the carried values.

    Both branches read the same source, so each micro-batch holds the carried
    values of exactly the cities whose readings it holds.
    """
    decoded = messages.decode(records)
    carry = carried_values(messages.readings(decoded), size)
    return decoded.select("*", F.lit(None).cast(CARRY).alias("carry")).unionByName(
        carry.select(F.struct(*CARRY.names).alias("carry")), allowMissingColumns=True
    )


def write_monitored(
    batch: DataFrame,
    batch_id: int,
    out: Tables,
    size: int = WINDOW_SIZE,
    threshold: int = scoring.UNHEALTHY_THRESHOLD,
    multiplier: float = scoring.SPIKE_MULTIPLIER,
    split_rows: int = SPLIT_ROWS,
) -> None:
    """All results of one micro-batch. Repeating it leaves the tables as they are."""
    spark = batch.sparkSession
    with adaptive(spark):
        _write_monitored(spark, batch, batch_id, out, size, threshold, multiplier, split_rows)


def _write_monitored(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    out: Tables,
    size: int,
    threshold: int,
    multiplier: float,
    split_rows: int,
) -> None:
    # every result below reads the batch; keep it instead of decoding it again
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        records = batch.where(F.col("carry").isNull())
        carry = batch.where(F.col("carry").isNotNull()).select("carry.*")
        readings = new_readings(messages.readings(records), carry).persist(StorageLevel.MEMORY_AND_DISK)
        carried = carry.select("city", F.posexplode("carried").alias("seq", "aqi"))

        scored = scoring.score(readings, size, carried, split_rows)
        tables.write_batch(scored, out.scored, batch_id)
        # the written scores, so that nothing is averaged twice
        scored = tables.read_batch(spark, out.scored, batch_id, SCORED)
        tables.write_batch(scoring.outcomes(scored, threshold, multiplier), out.outcomes, batch_id)
        tables.write_batch(messages.undecodable(records).hint("rebalance"), out.rejects, batch_id)
        tables.write_batch(H.insert_rejects(readings).hint("rebalance"), out.insert_rejects, batch_id)
        tables.append_history(readings, out.history, batch_id)
        readings.unpersist()
    finally:
        batch.unpersist()


def run_monitor(
    records: DataFrame,
    root: str,
    size: int = WINDOW_SIZE,
    threshold: int = scoring.UNHEALTHY_THRESHOLD,
    multiplier: float = scoring.SPIKE_MULTIPLIER,
    split_rows: int = SPLIT_ROWS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the monitor over a stream of ``(seq, key, value)`` records.

    Micro-batches follow one another in arrival order; inside one, ``seq`` is
    the order. After a restart the state goes on from the checkpoint.
    """
    check_window(size)
    out = Tables(root)
    tables.create_history(records.sparkSession, out.history)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_monitored(batch, batch_id, out, size, threshold, multiplier, split_rows)

    return (
        monitored(records, size)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", out.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def status_now(spark: SparkSession, root: str, city: str | None = None) -> DataFrame:
    """Current status of one city or of all, while the stream runs or after it.

    Read from the keyed state as of the last completed micro-batch; empty before the first.
    """
    out = Tables(root)
    if not files.names(spark, f"{out.checkpoint}/commits"):
        return spark.createDataFrame([], STATUS)
    return read_state(spark, out.checkpoint, city).select(
        "city",
        F.element_at("values", -1).alias("currentAqi"),
        ema_of_array(F.col("values")).alias("ema"),
        *STATUS_COLUMNS[3:],
    )


def read_scored(spark, root: str) -> DataFrame:
    return tables.read_table(spark, Tables(root).scored, SCORED)


def read_outcomes(spark, root: str) -> DataFrame:
    return tables.read_table(spark, Tables(root).outcomes, OUTCOME)


def read_rejects(spark, root: str) -> DataFrame:
    return tables.read_table(spark, Tables(root).rejects, REJECT)


def read_insert_rejects(spark, root: str) -> DataFrame:
    return tables.read_table(spark, Tables(root).insert_rejects, INSERT_REJECT)

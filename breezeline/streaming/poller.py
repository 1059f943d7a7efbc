"""The poller: landed responses in; topic records, rejects and invalidations out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry as R
from ..operators import responses
from ..operators.messages import encode, topic_part
from ..operators.skew import SPLIT_ROWS
from ..schemas import RESPONSE
from ..sources import tables
from ..sources.registry_store import RegistryStore

REJECT = T.StructType([*RESPONSE.fields, T.StructField("error", T.StringType())])
INVALID = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("rows_affected", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
RELOAD = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("old_count", T.LongType()),
        T.StructField("new_count", T.LongType()),
        T.StructField("change", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("rows_affected", T.LongType()),
    ]
)


def publish_files(events: DataFrame, batch_id: int, root: str) -> None:
    """Records as files. No shuffle: each task writes where its keys belong.

    A batch that is repeated after its files were published is not published
    again, since a reader of the topic would take the new files for new records.
    """
    path = f"{root}/topic/batch_id={batch_id}"
    if not tables.is_written(events.sparkSession, path):
        records = encode(events).withColumn("part", topic_part(F.col("key")))
        records.write.mode("overwrite").partitionBy("part").parquet(path)


def write_polled(
    batch: DataFrame,
    batch_id: int,
    root: str,
    registry: RegistryStore | Callable[[SparkSession], DataFrame],
    split_rows: int = SPLIT_ROWS,
    publish: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """All results of one micro-batch of responses.

    A city leaves the poll after the batch that found its station unknown. With
    a ``RegistryStore`` the batch works on the version that was the newest at
    its first attempt, writes how that differs from the batch before, and commits
    its invalidations as a change of its own time, so that a later change can
    enable the city again. With a function, which loads a registry that the
    stream may not write, the invalidations of all earlier batches are applied.
    """
    spark = batch.sparkSession
    store = registry if isinstance(registry, RegistryStore) else None
    if store:
        version = store.pin(_poll(batch_id))
        entries = store.read(version)
    else:
        earlier = tables.read_table(spark, f"{root}/invalid", INVALID).where(
            F.col("batch_id") < batch_id
        )
        entries = R.mark_invalid(registry(spark), earlier)
    polled = R.of_valid_cities(batch, entries, split_rows)
    classified = responses.classify(polled).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        events = responses.events(classified)
        if publish is None:
            publish_files(events, batch_id, root)
        else:
            publish(events, batch_id)
        tables.write_batch(responses.rejects(classified), f"{root}/rejects", batch_id)
        report = R.invalidation_report(entries, responses.invalid_cities(classified))
        tables.write_batch(report, f"{root}/invalid", batch_id)
    finally:
        classified.unpersist()
    if store:
        invalid = tables.read_batch(spark, f"{root}/invalid", batch_id, INVALID)
        changes = invalid.select("name", F.lit(False).alias("valid_entry"))
        affected = store.change(changes, tag=_poll(batch_id)).affected
        tables.write_batch(_reload(spark, store, version, batch_id, affected), f"{root}/reloads", batch_id)


def _poll(batch_id: int) -> str:
    return f"poll-{batch_id}"


def _reload(spark: SparkSession, store: RegistryStore, version: int, batch_id: int, affected: int) -> DataFrame:
    """What the registry held at the batch before and holds at this one, and how many entries this one names.

    The counts were observed when the versions were written.
    """
    old = store.commit(store.pin(_poll(batch_id - 1))).valid if batch_id else 0
    row = [(version, old, store.commit(version).valid, affected)]
    counts = spark.createDataFrame(row, "version long, old_count long, new_count long, rows_affected long")
    return R.summarized(counts).select(*RELOAD.names)


def run_poller(
    landed: DataFrame,
    root: str,
    registry: RegistryStore | Callable[[SparkSession], DataFrame],
    split_rows: int = SPLIT_ROWS,
    publish: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the poller over a stream of ``(seq, city, status_code, body)``.

    ``registry`` is a versioned registry, which the stream writes, or a function that loads one.

    Readings go to topic files below ``root``, or to ``publish(events, batch_id)``,
    for instance one that calls ``topic.write_kafka``.
    """
    tables.create_table(
        landed.sparkSession,
        f"{root}/invalid",
        T.StructType([*INVALID.fields, tables.BATCH]),
        ["batch_id"],
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        write_polled(batch, batch_id, root, registry, split_rows, publish)

    return (
        landed.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_table(spark, f"{root}/rejects", REJECT)


def read_invalid(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_table(spark, f"{root}/invalid", INVALID)


def read_reloads(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_table(spark, f"{root}/reloads", RELOAD)

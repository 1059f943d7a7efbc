"""The topic of readings: a Kafka topic, or files with the same records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.messages import TOPIC_PARTS, encode, topic_part
from ..schemas import TOPIC_RECORD

TOPIC = "aqi-raw"
OFFSET_BITS = 44
NUMBER = "seq"  # header with a reading's arrival number at the publisher


def arrival_number(partition: Column, offset: Column) -> Column:
    """One number that orders the records of a partition.

    A city is always in one partition, so it orders a city's records. An offset
    that would run into the partition's bits is an error.
    """
    number = F.shiftleft(partition.cast("long"), OFFSET_BITS) + offset
    error = F.raise_error(F.lit(f"offset of {OFFSET_BITS} bits or more")).cast("long")
    return F.when(offset < F.lit(1 << OFFSET_BITS), number).otherwise(error)


def stream_kafka(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    starting: str = "latest",
    max_records: int | None = None,
    **options,
) -> DataFrame:
    """Records from the newest on; the query's checkpoint keeps the position.

    A record that carries its publisher's number keeps it, so that one that is
    sent again is known for a repeat; others are numbered by their place.

    Needs the Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("includeHeaders", "true")
        .options(**options)
    )
    if max_records:
        reader = reader.option("maxOffsetsPerTrigger", max_records)
    return from_kafka(reader.load())


def from_kafka(rows: DataFrame) -> DataFrame:
    """``(seq, key, value)`` of rows as the Kafka source gives them, headers included."""
    own = F.filter("headers", lambda h: h["key"] == NUMBER)
    number = F.get(own, F.lit(0))["value"].cast("string").try_cast("long")
    return rows.select(
        F.coalesce(number, arrival_number(F.col("partition"), F.col("offset"))).alias("seq"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def to_kafka(readings: DataFrame) -> DataFrame:
    """``(key, value, headers)``, each city's records in one task and in order of their numbers.

    The number goes along as a header. A task that is run again sends its records again, in order
    again, so a reader that takes only growing numbers of a city takes each record once.
    """
    numbered = F.array(F.struct(F.lit(NUMBER).alias("key"), F.encode(F.col("seq").cast("string"), "utf-8").alias("value")))
    records = encode(readings).repartition("key").sortWithinPartitions("key", "seq")
    return records.select("key", "value", numbered.alias("headers"))


def write_kafka(readings: DataFrame, servers: str, topic: str = TOPIC, **options) -> None:
    """Appends readings; the broker places each record by its key, the city."""
    (
        to_kafka(readings)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "1")
        .option("kafka.compression.type", "snappy")
        .option("topic", topic)
        .options(**options)
        .save()
    )


def write_files(
    readings: DataFrame, path: str, mode: str = "append", parts: int = TOPIC_PARTS
) -> None:
    """Appends readings as record files, one folder per part of the topic.

    A city's records share a folder. No shuffle: tasks write where keys belong.
    """
    (
        encode(readings)
        .withColumn("part", topic_part(F.col("key"), parts))
        .write.mode(mode)
        .partitionBy("part")
        .parquet(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOPIC_RECORD).parquet(path)


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """All files landed since the last micro-batch.

    A landed slice is many files without an order, so a micro-batch takes whole
    slices: its size is bounded by what is landed between two triggers.
    """
    return spark.readStream.schema(TOPIC_RECORD).parquet(path)

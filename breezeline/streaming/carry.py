"""Keyed state of the stream: the last values of every city, its last reading and its number.

The state store keeps at most ``size`` ints and one reading per city. A call of
Python for each city would cost more than all else the stream does, so a key of
the store is one of ``BUCKETS`` buckets, and its value holds the bucket's
cities as arrays of one length. What reaches a bucket's task is already cut
down map side: each Arrow batch sends at most its last ``size`` readings per
city, so a hot city costs its task a thousandth of its rows; the task holds
``size`` readings per city at any time, next to one Arrow batch.

A reading counts once. Its arrival number increases within a city, so one whose
number is not above the last accepted one has come before, as it does when a
publisher sends a batch again; it changes neither values nor averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..schemas import STATUS

LAST = T.StructType(STATUS.fields[3:])  # what the current status shows of the last reading, but for city and aqi
BUCKETS = 1024  # a checkpoint goes on only with the number it was begun with
BUCKET = T.StructField("bucket", T.IntegerType())
SENT = T.StructType(
    [
        BUCKET,
        T.StructField("city", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("aqi", T.IntegerType()),
        *LAST.fields,
    ]
)
KEPT = T.StructType(  # of one city
    [
        T.StructField("city", T.StringType()),
        T.StructField("values", T.ArrayType(T.IntegerType())),  # oldest first
        T.StructField("seq", T.LongType()),  # of the last accepted reading
        *LAST.fields,
    ]
)
STATE = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in KEPT.fields])  # of a bucket's cities
CARRY = T.StructType(
    [
        T.StructField("city", T.StringType()),
        # last values before this micro-batch, oldest first, and the number of the last one
        T.StructField("carried", T.ArrayType(T.IntegerType())),
        T.StructField("before", T.LongType()),
    ]
)
NO_NUMBER = -(1 << 63)  # before a city's first reading


def bucket_of(city: Column) -> Column:
    return F.pmod(F.xxhash64(city), F.lit(BUCKETS)).cast("int")


def last_readings(size: int):
    def cut(batches):
        for batch in batches:
            once = batch.sort_values("seq").drop_duplicates(["city", "seq"])
            yield once.groupby("city", sort=False).tail(size)

    return cut


def remember(size: int):
    def update(key, batches, state):
        import pandas as pd

        kept = {row[0]: row for row in zip(*state.get)} if state.exists else {}
        seen = {city: row[2] for city, row in kept.items()}
        cities, newest = {}, None  # the cities that sent something, in order of appearance
        for batch in batches:
            cities.update(dict.fromkeys(batch["city"]))
            batch = batch[batch["seq"] > batch["city"].map(lambda c: seen.get(c, NO_NUMBER))]
            both = batch if newest is None else pd.concat([newest, batch])
            once = both.sort_values("seq").drop_duplicates(["city", "seq"])
            newest = once.groupby("city", sort=False).tail(size)
        before = [kept.get(city) for city in cities]
        if len(newest):
            arrived = newest.groupby("city", sort=False)["aqi"].agg(list)
            last = newest.drop_duplicates("city", keep="last")
            shown = zip(last["city"], last["seq"].tolist(), *(last[f.name].tolist() for f in LAST.fields))
            for city, number, *rest in shown:
                carried = kept[city][1] if city in kept else []
                kept[city] = (city, (list(carried) + arrived[city])[-size:], number, *rest)
            state.update(tuple(map(list, zip(*kept.values()))))
        yield pd.DataFrame(
            {
                "city": list(cities),
                "carried": [list(row[1]) if row else [] for row in before],
                "before": [row[2] if row else NO_NUMBER for row in before],
            }
        )

    return update


def carried_values(readings: DataFrame, size: int) -> DataFrame:
    """Per micro-batch, one row for each city that sent something.

    No watermark and no timeout: order is arrival order and state stays.
    """
    return (
        readings.withColumn(BUCKET.name, bucket_of(F.col("city")))
        .select(*SENT.names)
        .mapInPandas(last_readings(size), SENT)
        .groupBy(BUCKET.name)
        .applyInPandasWithState(
            remember(size), CARRY, STATE, "append", GroupStateTimeout.NoTimeout
        )
    )


def new_readings(readings: DataFrame, carry: DataFrame) -> DataFrame:
    """A micro-batch's readings without those that came before, in it or in an earlier one."""
    before = carry.where(F.col("before") > NO_NUMBER).select("city", "before")
    known = readings.dropDuplicates(["city", "seq"]).join(before, "city", "left")
    return known.where(F.col("before").isNull() | (F.col("seq") > F.col("before"))).select(*readings.columns)


def read_state(spark: SparkSession, checkpoint: str, city: str | None = None) -> DataFrame:
    """``(city, values, seq, ...)`` of one city or all as of the last completed micro-batch, from the state store.

    Readable while the stream runs. Files are opened by state partition, however
    many micro-batches there have been.
    """
    kept = spark.read.format("statestore").load(checkpoint)
    if city is not None:
        kept = kept.where(F.col(f"key.{BUCKET.name}") == bucket_of(F.lit(city)))
    rows = F.arrays_zip(*[F.col(f"value.groupState.{n}").alias(n) for n in KEPT.names])
    cities = kept.select(F.inline(rows).alias(*KEPT.names))
    return cities if city is None else cities.where(F.col("city") == city)

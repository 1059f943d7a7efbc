"""The library's inputs, derived from the given star-schema tables.

``events`` is the stream of readings: a user is a city, arrival order is the
event id. ``customer`` with its nation and region is the registry; user ids are
customer keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ntz_to_seconds

DAY = 86400
CITY = "7"  # the city of single look-ups


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("city"),
        F.floor(value).cast("int").alias("aqi"),
        (value / 4).alias("co"),
        (value / 8).alias("no2"),
        (value / 2).alias("pm10"),
        value.alias("pm25"),
        (value / 4 - 10).alias("temperature"),
        ntz_to_seconds(F.col("ts")).alias("timestamp"),
        F.lit(45.5).alias("latitude"),
        F.lit(9.25).alias("longitude"),
    )


def daily_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, stamped with the start of their day, so that keys repeat."""
    day = F.floor(F.col("timestamp") / DAY) * DAY
    return readings(spark, sf_dir).withColumn("timestamp", day)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cities; some flags are false and some are NULL."""
    balance = F.col("c_acctbal")
    valid = F.when(balance >= 0, True).when(F.col("c_mktsegment") != "MACHINERY", False)
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").cast("int").alias("id"),
            F.col("c_custkey").cast("string").alias("name"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("continent"),
            valid.alias("valid_entry"),
            F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("created_at"),
        )
    )


def dated_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with the time of each flag's last change, unknown for some."""
    day = F.col("id") % 40
    at = F.when(day < 35, F.timestamp_seconds(F.lit(1704067200) + day * DAY))
    return registry(spark, sf_dir).withColumn("flag_at", at)


def flag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors make a city invalid, purchases make it valid again, at the minute they happen."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").where(kind.isin("error", "purchase")).select(
        F.col("user_id").cast("string").alias("name"),
        (kind == "purchase").alias("valid_entry"),
        F.timestamp_seconds(F.floor(ntz_to_seconds(F.col("ts")) / 60) * 60).alias("flag_at"),
    )


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as new cities, named after their nation, so names repeat, plus
    the customers, whose names are taken."""
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("position"),
            F.lower("n_name").alias("name"),
            F.col("s_name").alias("country"),
            F.lit("new").alias("continent"),
        )
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("position"),
        F.col("c_custkey").cast("string").alias("name"),
        F.lit("taken").alias("country"),
        F.lit("taken").alias("continent"),
    )
    return suppliers.unionByName(customers)


def supplier_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of ``seed`` alone."""
    return seed(spark, sf_dir).where("continent = 'new'")


# Response bodies by event number modulo their count; {a} is the reading's
# whole value and {e} its time in epoch seconds. None stands for no body.
BODIES = [
    '{"status":"error","data":"Unknown station"}',
    '{"status":"error","data":"Too many calls"}',
    '{"status":"error"}',
    '{"status":"error","data":null}',
    '{"status":"nug","data":"x"}',
    '{"status":"ok","data":"maintenance"}',
    '{"status":"ok","data":{"aqi":"-"}}',
    "not json",
    '{"status":"ok","data":{"aqi":{a},"time":{"v":{e}}}}',
    '{"status":"ok","data":{"aqi":{a},"city":{"geo":[45.5,9.25],"name":"elsewhere"},'
    '"iaqi":{"co":{"v":3.5},"pm25":{"v":{a}.5}},"time":{"v":{e}}}}',
    '{"status":"ok","data":{"aqi":{a},"idx":7,"dominentpol":"pm25","city":{"geo":[1,2,"x"],'
    '"url":"u","location":"l"},"iaqi":{"no2":{"v":{a}},"pm10":{"v":1e1},"t":{"v":-3}},'
    '"time":{"s":"s","tz":"z","iso":"i","v":{e}}}}',
    '{"status":"ok","data":{"aqi":{a},"city":null,"iaqi":{"co":null,"t":{"v":null}},'
    '"time":{"v":{e}}}}',
    "[1]",
    "null",
    '{"status":5,"data":{}}',
    '{"status":"ok"}',
    '{"status":"ok","data":{"aqi":{a}.5}}',
    '{"status":"ok","data":{"aqi":{a},"city":{"geo":[45.5]},"dominentpol":null}}',
    '{"status":"ok","data":{"aqi":{a},"iaqi":{"pm10":5}}}',
    '{"status":"ok","data":{"aqi":{a},"city":{"geo":["x",1]}}}',
    '{"status":"ok","data":{"aqi":{a},"time":{"v":{e}}}} more',
    '{"status":"ok","data":{"aqi":99999999999}}',
    "Internal Server Error",
    None,
    '{"status":"ok","data":{"aqi":{a},"time":{"v":"{e}"}}}',
    '{"status":null,"data":{"aqi":{a}}}',
    '{"status":"ok","data":[1]}',
]
SERVER_ERROR = BODIES.index("Internal Server Error")
NO_RESPONSE = BODIES.index(None)
NO_CITY = BODIES.index("null")


def _filled(template: str | None, **values: Column) -> Column:
    """A template text with its {name} places replaced by columns."""
    text = F.lit(template).cast("string")
    for name, value in values.items():
        if template and f"{{{name}}}" in template:
            text = F.replace(text, F.lit(f"{{{name}}}"), value.cast("string"))
    return text


def _one_of(templates: list[str | None], **values: Column) -> Column:
    number = F.col("seq") % len(templates)
    chosen = F
    for i, template in enumerate(templates):
        chosen = chosen.when(number == i, _filled(template, **values))
    return chosen


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed response per event: every body above, with failed requests,
    server errors and empty city names among them."""
    number = F.col("seq") % len(BODIES)
    return readings(spark, sf_dir).select(
        "seq",
        F.when((number == NO_CITY) & (F.col("aqi") > 50), "").otherwise(F.col("city")).alias("city"),
        F.when(number == NO_RESPONSE, None)
        .when(number == SERVER_ERROR, 500)
        .otherwise(200)
        .cast("int")
        .alias("status_code"),
        _one_of(BODIES, a=F.col("aqi"), e=F.col("timestamp")).alias("body"),
    )


# Topic values by event number modulo their count; {c}, {a}, {e} as above.
_REST = '"co":1.5,"no2":2,"pm10":3.25,"pm25":4.0,"temperature":-5.5,'
VALUES = [
    '{"city":"{c}","aqi":{a},' + _REST + '"timestamp":{e},"latitude":45.5,"longitude":9.25}',
    '{"city":"{c}","aqi":{a}.9,' + _REST + '"timestamp":{e},"latitude":45.5,"longitude":9.25,"x":[1]}',
    '{"city":"{c}","aqi":{a},' + _REST + '"timestamp":{e},"latitude":45.5}',
    '{"city":"{c}","aqi":"{a}",' + _REST + '"timestamp":{e},"latitude":45.5,"longitude":9.25}',
    '{"city":{c},"aqi":{a},' + _REST + '"timestamp":{e},"latitude":45.5,"longitude":9.25}',
    '{"city":"{c}","aqi":{a},' + _REST + '"timestamp":{e},"latitude":45.5,"longitude":9.25} x',
    '{"city":"{c}","aqi":null,' + _REST + '"timestamp":{e},"latitude":45.5,"longitude":9.25}',
    "",
    "not json",
    "[]",
]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic record per event, most of them damaged in some way."""
    return readings(spark, sf_dir).select(
        "seq",
        F.col("city").alias("key"),
        _one_of(VALUES, c=F.col("city"), a=F.col("aqi"), e=F.col("timestamp")).alias("value"),
    )

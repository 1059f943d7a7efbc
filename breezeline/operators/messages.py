"""Topic records: a reading as keyed JSON, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_values as J
from ..functions.numbers import wrapped_int
from ..schemas import READING

READING_COLUMNS = [f.name for f in READING.fields]
DOUBLES = ["co", "no2", "pm10", "pm25", "temperature", "latitude", "longitude"]
TOPIC_PARTS = 10


def encode(readings: DataFrame) -> DataFrame:
    """``(seq, key, value)``: the city, and the ten fields as JSON in order."""
    return readings.select(
        "seq",
        F.col("city").alias("key"),
        F.to_json(F.struct(*READING_COLUMNS)).alias("value"),
    )


def topic_part(key: Column, parts: int = TOPIC_PARTS) -> Column:
    """Which of the topic's parts a key always goes to."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _whole(kind: Column, value: Column) -> Column:
    """An integer, or another number cut toward zero; NULL if that does not fit 64 bits.

    A number written with a fraction is cut digit by digit, so that none is lost; one written
    with an exponent, or with more digits than a DECIMAL has, is a double.
    """
    number = J.double_of(value)
    fits = F.abs(number) < F.lit(float(2**63))
    cut = F.when(fits, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    digits = F.regexp_extract(J.text_of(value), "^-?[0-9]+", 0).try_cast("long")
    return (
        F.when(kind == "BIGINT", J.long_of(value))
        .when(kind.startswith("DECIMAL"), digits)
        .when(J.is_number(kind), cut.cast("long"))
    )


def _double(kind: Column, value: Column) -> Column:
    """A number, or NaN for JSON null."""
    return F.when(kind == J.ABSENT, F.lit(float("nan"))).when(
        J.is_number(kind), J.double_of(value)
    )


def decode(records: DataFrame) -> DataFrame:
    """Adds ``reading``: all ten fields, or NULL if the value does not decode.

    Every field must be there. The city must be a text; whole-number fields
    take any number and cut its fraction (aqi then keeps its low 32 bits); the
    others take any number, or null as NaN. Further fields are ignored. No
    shuffle.
    """
    field = {name: F.col(f"_message.{name}") for name in READING_COLUMNS}
    kind = {name: F.col(f"_kind_{name}") for name in READING_COLUMNS}
    typed = {
        "city": F.when(kind["city"] == "STRING", J.text_of(field["city"])),
        "aqi": wrapped_int(_whole(kind["aqi"], field["aqi"])),
        "timestamp": _whole(kind["timestamp"], field["timestamp"]),
        **{name: _double(kind[name], field[name]) for name in DOUBLES},
    }
    reading = F.struct(*[typed[name].alias(name) for name in READING_COLUMNS])
    complete = F.lit(True)
    for name in READING_COLUMNS:
        complete = complete & F.col(f"_reading.{name}").isNotNull()
    typed_rows = (
        J.with_parsed(records, "value", "_json")
        .withColumn("_message", J.members(F.col("_json"), READING_COLUMNS))
        .withColumns({f"_kind_{n}": J.kind_if_present(c) for n, c in field.items()})
        .withColumn("_reading", reading)
    )
    return J.computed_once(
        typed_rows, records.columns, reading=F.when(complete, F.col("_reading"))
    )


def readings(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reading").isNotNull()).select("seq", "reading.*")


def undecodable(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reading").isNull()).select("seq", "key", "value")

"""Bulk classification of landed API responses into readings and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_values as J
from ..schemas import READING

READING_COLUMNS = [f.name for f in READING.fields]

# Member names of the response, error texts.
UNKNOWN_STATION = "Unknown station"
EMPTY_CITY = "city name cannot be empty"
REQUEST_FAILED = "failed to execute request"
BODY_UNREAD = "failed to read response body"
BAD_ENVELOPE = "Error parsing AQI JSON"
UNKNOWN_STATION_ERROR = "unknown station"
API_ERROR = "API error: "
NO_MESSAGE = "API returned error status without message"
NON_OK = "API returned non-ok status: "
BAD_DATA = "error parsing AQI data"

POLLUTANTS = ["co", "no2", "pm10", "pm25", "t"]


def _all(*checks: Column) -> Column:
    result = checks[0]
    for check in checks[1:]:
        result = result & check
    return result


def _texts_ok(*paths: str) -> Column:
    return F.forall(F.array(*[J.kind(F.col(p)) for p in paths]), J.accepts_text)


def _wholes_ok(*paths: str) -> Column:
    return F.forall(F.array(*[J.kind(F.col(p)) for p in paths]), J.accepts_whole)


def _double_ok(value: Column) -> Column:
    return J.accepts_double(J.kind(value), value)


def _decoded(responses: DataFrame) -> DataFrame:
    """Adds the typed parts of each body and ``_ok``, whether all types fit.

    One projection per level of nesting, each carrying on only what the next
    one needs: no path is walked twice, and the rows stay narrow enough for
    generated code.
    """
    c = F.col
    kept = responses.columns
    rows = (
        J.with_parsed(responses, "body", "_body")
        .withColumn("_envelope", J.members(c("_body"), ["status", "data"]))
        .select(
            *kept,
            F.is_variant_null("_body").alias("_null_body"),
            c("_envelope").isNotNull().alias("_is_object"),
            J.kind(c("_envelope.status")).alias("_status_kind"),
            J.text_or_empty(c("_envelope.status")).alias("_status"),
            J.kind_if_present(c("_envelope.data")).alias("_data_kind"),
            c("_envelope.data").alias("_data"),
        )
    )
    kept = [*kept, "_null_body", "_is_object", "_status_kind", "_status", "_data_kind"]
    rows = rows.select(
        *kept,
        F.when(c("_data_kind") == "STRING", J.text_of(c("_data"))).otherwise("").alias("_text"),
        J.members(c("_data"), ["aqi", "idx", "city", "dominentpol", "iaqi", "time"]).alias("_d"),
    )
    kept.append("_text")
    rows = rows.select(
        *kept,
        J.int_of(c("_d.aqi")).alias("_aqi"),
        J.members(c("_d.city"), ["geo", "name", "url", "location"]).alias("_city"),
        J.members(c("_d.iaqi"), POLLUTANTS).alias("_iaqi"),
        J.members(c("_d.time"), ["s", "tz", "v", "iso"]).alias("_time"),
        "_d",
    )
    kept.append("_aqi")
    rows = rows.select(
        *kept,
        _all(
            c("_d").isNotNull(),
            J.is_shape(c("_city"), c("_d.city")),
            J.is_shape(c("_iaqi"), c("_d.iaqi")),
            J.is_shape(c("_time"), c("_d.time")),
            _wholes_ok("_d.aqi", "_d.idx", "_time.v"),
            c("_aqi").isNotNull() | (J.kind(c("_d.aqi")) == J.ABSENT),
            _texts_ok(
                "_d.dominentpol", "_city.name", "_city.url", "_city.location",
                "_time.s", "_time.tz", "_time.iso",
            ),
        ).alias("_ok"),
        J.long_of(c("_time.v")).alias("_seconds"),
        c("_city.geo").alias("_geo_value"),
        J.elements(c("_city.geo")).alias("_geo"),
        "_iaqi",
        *[J.members(c(f"_iaqi.{p}"), ["v"]).alias(f"_{p}") for p in POLLUTANTS],
    )
    kept.append("_seconds")
    rows = rows.select(
        *kept,
        _all(
            c("_ok"),
            J.is_shape(c("_geo"), c("_geo_value")),
            *[J.is_shape(c(f"_{p}"), c(f"_iaqi.{p}")) for p in POLLUTANTS],
        ).alias("_ok"),
        # only the first two elements of the position are read
        F.try_element_at("_geo", F.lit(1)).alias("_lat"),
        F.try_element_at("_geo", F.lit(2)).alias("_lon"),
        *[c(f"_{p}.v").alias(f"_{p}") for p in POLLUTANTS],
    )
    doubles = ["_lat", "_lon", *[f"_{p}" for p in POLLUTANTS]]
    return rows.select(
        *kept,
        _all(c("_ok"), *[_double_ok(c(d)) for d in doubles]).alias("_ok"),
        *[F.coalesce(J.double_of(c(d)), F.lit(0.0)).alias(d) for d in doubles],
    )


def classify(responses: DataFrame) -> DataFrame:
    """Adds ``error`` (NULL for a good response), ``invalidates`` and ``reading``.

    Checks run in a fixed order and the first match wins. ``invalidates`` marks
    the answer after which the city leaves the registry. ``reading`` carries
    the requested city, never the one named in the response, and zeros for
    whatever the response leaves out. No shuffle.
    """
    c = F.col
    status, text = c("_status"), c("_text")
    # JSON null reads as an empty text
    has_text = F.coalesce(J.accepts_text(c("_data_kind")), F.lit(False))
    envelope_ok = F.coalesce(
        c("_null_body") | (c("_is_object") & J.accepts_text(c("_status_kind"))), F.lit(False)
    )
    unknown = (status == "error") & has_text & (text == UNKNOWN_STATION)
    error = (
        F.when(F.coalesce(c("city"), F.lit("")) == "", F.lit(EMPTY_CITY))
        .when(c("status_code").isNull(), F.lit(REQUEST_FAILED))
        .when(
            ~c("status_code").between(200, 299),
            F.concat(
                F.lit("non-2xx response: "),
                c("status_code").cast("string"),
                F.lit(" - "),
                F.coalesce("body", F.lit("")),
            ),
        )
        .when(c("body").isNull(), F.lit(BODY_UNREAD))
        .when(~envelope_ok, F.lit(BAD_ENVELOPE))
        .when(unknown, F.lit(UNKNOWN_STATION_ERROR))
        .when((status == "error") & has_text, F.concat(F.lit(API_ERROR), text))
        .when(status == "error", F.lit(NO_MESSAGE))
        .when(status != "ok", F.concat(F.lit(NON_OK), status))
        .when(has_text, F.concat(F.lit(API_ERROR), text))
        .when(~c("_ok"), F.lit(BAD_DATA))
    )

    reading = F.struct(
        c("city"),
        F.coalesce("_aqi", F.lit(0)).alias("aqi"),
        c("_co").alias("co"),
        c("_no2").alias("no2"),
        c("_pm10").alias("pm10"),
        c("_pm25").alias("pm25"),
        c("_t").alias("temperature"),
        F.coalesce("_seconds", F.lit(0).cast("long")).alias("timestamp"),
        c("_lat").alias("latitude"),
        c("_lon").alias("longitude"),
    )
    return J.computed_once(
        _decoded(responses).withColumn("error", error),
        responses.columns,
        error=c("error"),
        invalidates=F.coalesce(c("error") == UNKNOWN_STATION_ERROR, F.lit(False)),
        reading=F.when(c("error").isNull(), reading),
    )


def events(classified: DataFrame) -> DataFrame:
    """The flat readings of good responses, with their arrival number."""
    return classified.where(F.col("error").isNull()).select("seq", "reading.*")


def rejects(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("error").isNotNull()).select(
        "seq", "city", "status_code", "body", "error"
    )


def invalid_cities(classified: DataFrame) -> DataFrame:
    """Cities whose station is unknown, each once (map-side combined)."""
    return classified.where("invalidates").select(F.col("city").alias("name")).distinct()

"""Rows and brute-force answers for the tests."""

from __future__ import annotations

from breezeline.schemas import MEASUREMENT, RESPONSE


def reading(seq, city, aqi, timestamp=1600000000, **other):
    row = dict(
        seq=seq, city=city, aqi=aqi, co=0.5, no2=7.0, pm10=11.0, pm25=13.0, temperature=21.0,
        timestamp=timestamp, latitude=-12.25, longitude=130.5,
    )
    row.update(other)
    return tuple(row[f.name] for f in MEASUREMENT.fields)


def readings(spark, rows):
    return spark.createDataFrame(list(rows), MEASUREMENT)


def sequence(spark, city, values):
    return readings(spark, [reading(i, city, v) for i, v in enumerate(values)])


def responses(spark, rows):
    return spark.createDataFrame(
        [(i, city, code, body) for i, (city, code, body) in enumerate(rows)], RESPONSE
    )


def fold(values):
    if not values:
        return None
    weight = 2.0 / (len(values) + 1)
    acc = float(values[0])
    for v in values:
        acc = weight * v + (1 - weight) * acc
    return acc


def brute_force(rows, size, carried=None):
    """{seq: (before, after)} of (seq, city, aqi) rows, one by one."""
    queues = {c: list(v)[-size:] for c, v in (carried or {}).items()}
    out = {}
    for seq, city, aqi in sorted(rows):
        queue = queues.get(city, [])
        before = fold(queue)
        queue = (queue + [aqi])[-size:]
        queues[city] = queue
        out[seq] = (before, fold(queue))
    return out

import json

from data import fold, reading, readings, sequence

from breezeline.operators import scoring, status


def test_status_includes_the_last_reading(spark):
    rows = readings(spark, [reading(0, "a", 50), reading(1, "a", 100, co=2.5, timestamp=9)])
    got = status.city_status(rows).collect()
    assert len(got) == 1
    assert got[0].asDict() == dict(
        city="a", currentAqi=100, ema=fold([50, 100]), co=2.5, no2=7.0, pm10=11.0, pm25=13.0,
        temperature=21.0, timestamp=9,
    )


def test_latest_is_last_arrived(spark):
    rows = readings(spark, [reading(1, "a", 10, timestamp=900), reading(2, "a", 20, timestamp=100)])
    assert status.city_status(rows).first().currentAqi == 20
    assert status.latest_reading(rows).first().aqi == 20


def test_unknown_city_has_no_row(spark):
    assert status.city_status(sequence(spark, "a", [1]), "b").collect() == []


def test_both_ways_agree(spark):
    rows = readings(spark, [reading(i, f"c{i % 3}", i * 7 % 50) for i in range(80)])
    a = status.city_status(rows).orderBy("city").collect()
    b = status.status_of_scored(scoring.score(rows)).orderBy("city").collect()
    assert a == b


def test_replies(spark):
    requested = spark.createDataFrame([("a",), ("b",), ("a",)], "city string")
    current = status.city_status(sequence(spark, "a", [42]))
    got = {r.city: (r.found, json.loads(r.reply)) for r in status.status_replies(requested, current).collect()}
    assert got["b"] == (False, {"error": "City 'b' not found or no data yet"})
    assert got["a"][0] and list(got["a"][1]) == status.STATUS_COLUMNS
    assert got["a"][1]["timestamp"] == 1600000000


def test_known_and_unknown(spark):
    rows = readings(spark, [reading(0, "a", 1), reading(1, "a", 2), reading(2, "b", 1)])
    known = status.known_cities(rows)
    assert sorted(r.city for r in known.collect()) == ["a", "b"]
    requested = spark.createDataFrame([("a",), ("z",), ("z",)], "city string")
    assert [r.city for r in status.unknown_cities(requested, known).collect()] == ["z"]

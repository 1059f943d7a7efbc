import json
import math

from data import reading, readings

from breezeline.operators import messages as M
from breezeline.schemas import READING, TOPIC_RECORD
from breezeline.sources import topic

GOOD = dict(
    city="a", aqi=5, co=1.5, no2=2.0, pm10=3.0, pm25=4.0, temperature=-1.0, timestamp=7,
    latitude=45.5, longitude=9.25,
)


def decoded(spark, *values):
    texts = [v if isinstance(v, str) or v is None else json.dumps(v) for v in values]
    return M.decode(
        spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], TOPIC_RECORD)
    )


def test_encode_field_order_and_key(spark):
    row = M.encode(readings(spark, [reading(3, "darwin", 42)])).first()
    assert (row.seq, row.key) == (3, "darwin")
    assert list(json.loads(row.value)) == READING.names
    assert row.value.startswith('{"city":"darwin","aqi":42,"co":0.5,')


def test_round_trip(spark):
    rows = [reading(i, f"ci\"ty é{i}", i - 2, timestamp=2**40 + i, co=i / 3) for i in range(5)]
    df = readings(spark, rows)
    got = M.readings(M.decode(M.encode(df)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


def test_rejects(spark):
    bad = [
        None, "", "not json", "[]", "null", "5", json.dumps(GOOD) + " x", json.dumps(GOOD)[:-1],
        *[{k: v for k, v in GOOD.items() if k != name} for name in GOOD],
        {**GOOD, "aqi": "5"}, {**GOOD, "aqi": None}, {**GOOD, "aqi": True}, {**GOOD, "city": 5},
        {**GOOD, "city": None}, {**GOOD, "co": "1.5"}, {**GOOD, "timestamp": None}, {**GOOD, "pm25": {}},
    ]
    df = decoded(spark, *bad)
    assert M.readings(df).count() == 0
    assert M.undecodable(df).count() == len(bad)


def test_number_forms(spark):
    df = decoded(
        spark,
        {**GOOD, "extra": [1]},
        {**GOOD, "aqi": 5.9, "timestamp": -7.9},
        {**GOOD, "aqi": 2**32 + 3},
        {**GOOD, "co": 3},
        json.dumps(GOOD).replace('"aqi": 5', '"aqi": 5e1'),
    )
    got = M.readings(df).orderBy("seq").collect()
    assert [(r.aqi, r.timestamp, r.co) for r in got] == [
        (5, 7, 1.5), (5, -7, 1.5), (3, 7, 1.5), (5, 7, 3.0), (50, 7, 1.5),
    ]


def test_null_double_is_nan(spark):
    row = M.readings(decoded(spark, {**GOOD, "pm10": None})).first()
    assert math.isnan(row.pm10) and row.pm25 == 4.0


def test_a_city_keeps_its_part(spark, tmp_path):
    rows = readings(spark, [reading(i, f"c{i % 5}", i) for i in range(100)]).repartition(4)
    topic.write_files(rows, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.groupBy("key").agg({"part": "count"}).count() == 5
    assert stored.select("key", "part").distinct().count() == 5
    assert topic.read_files(spark, str(tmp_path / "t")).count() == 100


def test_arrival_number_orders_a_partition(spark):
    df = spark.sql("select 3 p, 10L a, 11L b")
    a, b = df.select(
        topic.arrival_number(df.p, df.a).alias("a"), topic.arrival_number(df.p, df.b).alias("b")
    ).first()
    assert b == a + 1


def test_whole_numbers_are_exact(spark):
    """A fraction is cut off without going through a double; what is beyond 64 bits does not decode."""
    texts = ["9007199254740993.0", "-9007199254740993.9", "9223372036854775807.5", "9223372036854775808.0", "-0.5", "1e3", "1e30"]
    rest = {k: v for k, v in GOOD.items() if k != "timestamp"}
    values = [json.dumps(rest)[:-1] + f', "timestamp": {t}}}' for t in texts]
    got = {r.seq: r.reading and r.reading.timestamp for r in decoded(spark, *values).collect()}
    assert [got[i] for i in range(7)] == [9007199254740993, -9007199254740993, 2**63 - 1, None, 0, 1000, None]

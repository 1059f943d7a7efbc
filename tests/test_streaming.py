"""Streams give what the batch operators give, over restarts and repeats."""

import json
import random

import pytest
from data import brute_force, reading, readings
from pyspark.sql import types as T

from breezeline.operators import history as H
from breezeline.operators import messages, scoring, status
from breezeline.schemas import HISTORY, REGISTRY, RESPONSE
from breezeline.session import adaptive
from breezeline.sources import tables, topic
from breezeline.sources.responses import stream_responses
from breezeline.streaming import carry, monitor, poller


def stream_rows(count=240):
    """A third of the rows belong to one city; some keys repeat."""
    rng = random.Random(7)
    rows = []
    for seq in range(count):
        city = "hot" if rng.random() < 0.34 else f"c{rng.randrange(6)}"
        rows.append(reading(seq, city, rng.randrange(0, 300), timestamp=rng.randrange(40) * 5000))
    rows.append(reading(count, "x" * 65, 10))
    return rows


def run(spark, landing, root, **kw):
    monitor.run_monitor(topic.stream_files(spark, landing), root, **kw).awaitTermination()


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    """Three micro-batches, each in a run of its own, with hot cities split."""
    base = tmp_path_factory.mktemp("monitor")
    landing, root = str(base / "topic"), str(base / "out")
    rows = stream_rows()
    for i in range(3):
        topic.write_files(readings(spark, rows[i * 81 : (i + 1) * 81]), landing)
        if i == 1:
            damaged = spark.createDataFrame([(1000, "k", "not json", 0)], "seq long, key string, value string, part int")
            damaged.write.mode("append").partitionBy("part").parquet(landing)
        run(spark, landing, root, split_rows=20)
    return root, rows


def test_scores_equal_batch(spark, finished):
    root, rows = finished
    got = {r.seq: (r.ema_before, r.ema_after) for r in monitor.read_scored(spark, root).collect()}
    assert got == brute_force([(r[0], r[1], r[2]) for r in rows], 10)


def test_outcomes_equal_batch(spark, finished):
    root, rows = finished
    columns = ["seq", "position", "outcome", "details"]
    got = monitor.read_outcomes(spark, root).select(*columns).collect()
    want = scoring.outcomes(scoring.score(readings(spark, rows))).select(*columns).collect()
    assert sorted(got) == sorted(want)


def test_history_equals_batch(spark, finished):
    root, rows = finished
    got = tables.read_history(spark, monitor.Tables(root).history).select(*H.HISTORY_COLUMNS)
    want = H.new_history(readings(spark, rows), spark.createDataFrame([], HISTORY))
    assert sorted(got.collect()) == sorted(want.select(*H.HISTORY_COLUMNS).collect())


def test_status_equals_batch(spark, finished):
    root, rows = finished
    got = monitor.status_now(spark, root).collect()
    want = status.city_status(readings(spark, rows)).collect()
    assert sorted(got) == sorted(want)
    one = monitor.status_now(spark, root, "hot").collect()
    assert one == [r for r in want if r.city == "hot"]
    assert monitor.status_now(spark, root, "nowhere").collect() == []


def test_status_before_the_first_batch_is_empty(spark, tmp_path):
    assert monitor.status_now(spark, str(tmp_path)).collect() == []


def test_status_lookup_reads_state_not_batches(spark, tmp_path):
    """As many state partitions are read after six micro-batches as after one, while batch tables grow."""
    landing, root = str(tmp_path / "topic"), str(tmp_path / "out")
    tasks = []
    for i in range(6):
        topic.write_files(readings(spark, [reading(i, "a", 10 + i)]), landing)
        run(spark, landing, root)
        found = monitor.status_now(spark, root, "a")
        tasks.append(found.rdd.getNumPartitions())
        assert [(r.currentAqi, r.timestamp) for r in found.collect()] == [(10 + i, 1600000000)]
    assert len(set(tasks)) == 1
    assert len(list((tmp_path / "out" / "scored").glob("batch_id=*"))) == 6


def test_repeated_readings_count_once(spark, tmp_path):
    """A publisher that sends a batch again leaves scores, outcomes, history and status as they are."""
    landed, root = str(tmp_path / "landed"), str(tmp_path / "out")
    reg = spark.createDataFrame([(0, "a", None, None, True, None), (1, "b", None, None, True, None)], REGISTRY)
    body = '{{"status":"ok","data":{{"aqi":{0},"time":{{"v":{0}}}}}}}'
    values = [5, 9, 200, 7, 1, 80, 3, 150, 160, 2, 4, 6]

    def twice(events, batch_id):  # a batch that is repeated after it was published
        for _ in range(2):
            topic.write_files(events, str(tmp_path / "topic"))

    for i in range(3):
        rows = [(n, "ab"[n % 2], 200, body.format(v)) for n, v in list(enumerate(values))[i * 4 : i * 4 + 4]]
        spark.createDataFrame(rows, RESPONSE).write.mode("append").parquet(landed)
        polled = stream_responses(spark, landed, "parquet")
        poller.run_poller(polled, str(tmp_path / "poller"), lambda session: reg, publish=twice).awaitTermination()
        if i != 1:  # the second batch reaches the monitor with the third
            run(spark, str(tmp_path / "topic"), root)
    topic.write_files(readings(spark, [reading(1, "b", 9, timestamp=9)]), str(tmp_path / "topic"))  # long after
    run(spark, str(tmp_path / "topic"), root)
    got = {r.seq: (r.ema_before, r.ema_after) for r in monitor.read_scored(spark, root).collect()}
    assert got == brute_force([(n, "ab"[n % 2], v) for n, v in enumerate(values)], 10)
    assert monitor.read_scored(spark, root).count() == len(values)
    assert tables.read_history(spark, monitor.Tables(root).history).count() == len(values)
    assert {r.city: (r.currentAqi, r.timestamp) for r in monitor.status_now(spark, root).collect()} == {"a": (4, 4), "b": (6, 6)}


def test_kafka_records_keep_the_publishers_number_and_order(spark):
    rows = [reading(n, f"c{n % 5}", n) for n in (7, 3, 11, 30, 2, 12, 8, 40)]
    sent = topic.to_kafka(readings(spark, rows))
    parts = sent.rdd.glom().collect()
    seen = {}
    for number, part in enumerate(parts):
        for r in part:
            seen.setdefault(r.key, []).append((number, int(r.headers[0].value)))
    for numbers in seen.values():
        assert len({part for part, _ in numbers}) == 1 and numbers == sorted(numbers)
    other = spark.createDataFrame([("k", "v")], "key string, value string").selectExpr("key", "value", "null AS headers")
    taken = sent.unionByName(other).selectExpr(
        "cast(key as binary) key", "cast(value as binary) value", "headers", "3 AS partition", "5L AS offset"
    )
    got = topic.from_kafka(taken).collect()
    assert sorted(r.seq for r in got) == sorted([7, 3, 11, 30, 2, 12, 8, 40, (3 << topic.OFFSET_BITS) + 5])
    assert {r.value for r in got} == {r.value for r in sent.collect()} | {"v"}


def test_rejects_are_set_aside(spark, finished):
    root, _ = finished
    assert [r.value for r in monitor.read_rejects(spark, root).collect()] == ["not json"]
    assert [r.seq for r in monitor.read_insert_rejects(spark, root).collect()] == [240]


def test_repeated_batch_changes_nothing(spark, finished):
    root, rows = finished
    out = monitor.Tables(root)

    def content():
        return [
            sorted(map(str, spark.read.parquet(p).collect()))
            for p in (out.scored, out.outcomes, out.history, out.rejects)
        ]

    before = content()
    # the batch as the stream saw it, with the values carried into it
    records = messages.decode(messages.encode(readings(spark, rows[162:])))
    queues = {}
    for row in rows[:162]:
        queues.setdefault(row[1], []).append(row[2])
    carry = []
    for city in {r[1] for r in rows[162:]}:
        last = max((r[0] for r in rows[:162] if r[1] == city), default=None)
        carry.append((city, queues.get(city, [])[-10:], last))
    state = spark.createDataFrame(carry, "city string, carried array<int>, before long")
    batch = records.selectExpr(
        "*", "cast(null as struct<city string, carried array<int>, before long>) carry"
    ).unionByName(
        state.selectExpr("struct(city, carried, before) carry"), allowMissingColumns=True
    )
    monitor.write_monitored(batch, 2, out, split_rows=20)
    assert content() == before


def test_poller_drops_cities_found_unknown(spark, tmp_path):
    landing, root = str(tmp_path / "landed"), str(tmp_path / "out")
    good = json.dumps({"status": "ok", "data": {"aqi": 5, "time": {"v": 9}}})
    unknown = '{"status":"error","data":"Unknown station"}'
    reg = spark.createDataFrame(
        [(i, n, None, None, v, None) for i, (n, v) in enumerate([("a", True), ("b", True), ("c", False)])],
        REGISTRY,
    )
    polls = [
        [(0, "a", 200, good), (1, "b", 200, unknown), (2, "b", 200, good), (3, "c", 200, good)],
        [(4, "a", 200, "broken"), (5, "b", 200, good), (6, "a", 200, good)],
    ]
    for rows in polls:
        spark.createDataFrame(rows, RESPONSE).write.mode("append").parquet(landing)
        landed = stream_responses(spark, landing, "parquet")
        poller.run_poller(landed, root, lambda session: reg).awaitTermination()
    events = messages.readings(messages.decode(topic.read_files(spark, f"{root}/topic")))
    # b still counts in the batch that finds it unknown, and not after it
    assert sorted(r.seq for r in events.collect()) == [0, 2, 6]
    assert [(r.name, r.rows_affected) for r in poller.read_invalid(spark, root).collect()] == [("b", 1)]
    assert sorted(r.error for r in poller.read_rejects(spark, root).collect()) == [
        "Error parsing AQI JSON",
        "unknown station",
    ]


def test_poller_can_publish_elsewhere(spark, tmp_path):
    landing, seen = str(tmp_path / "landed"), []
    reg = spark.createDataFrame([(0, "a", None, None, True, None)], REGISTRY)
    rows = [(0, "a", 200, '{"status":"ok","data":{"aqi":5}}'), (1, "b", 200, "x")]
    spark.createDataFrame(rows, RESPONSE).write.parquet(landing)
    poller.run_poller(
        stream_responses(spark, landing, "parquet"),
        str(tmp_path / "out"),
        lambda session: reg,
        publish=lambda events, batch_id: seen.extend((batch_id, r.seq) for r in events.collect()),
    ).awaitTermination()
    assert seen == [(0, 0)]


def test_repeated_poll_publishes_once(spark, tmp_path):
    root = str(tmp_path / "out")
    reg = spark.createDataFrame([(0, "a", None, None, True, None)], REGISTRY)
    good = '{"status":"ok","data":{"aqi":5}}'
    batch = spark.createDataFrame([(i, "a", 200, good) for i in range(3)], RESPONSE)
    tables.create_table(spark, f"{root}/invalid", T.StructType([*poller.INVALID.fields, tables.BATCH]), ["batch_id"])
    for _ in range(2):
        poller.write_polled(batch, 0, root, lambda session: reg)
        run(spark, f"{root}/topic/batch_id=0", str(tmp_path / "monitor"))
    got = monitor.read_scored(spark, str(tmp_path / "monitor")).collect()
    assert sorted(r.seq for r in got) == [0, 1, 2]


def test_a_batch_is_written_adaptively_and_the_state_is_not(spark, tmp_path):
    """Few files a day however many shuffle partitions there are; the stream's own plan stays as it is."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "50")
    landing, root = str(tmp_path / "topic"), str(tmp_path / "out")
    rows = [reading(n, f"c{n}", n, timestamp=1600000000 + n % 3 * 86400) for n in range(300)]
    topic.write_files(session.createDataFrame(readings(spark, rows).rdd, readings(spark, rows).schema), landing)
    run(session, landing, root)
    files = list((tmp_path / "out" / "history").glob("date=*/batch_id=0/*.parquet"))
    assert len({f.parent for f in files}) == 3 and len(files) <= 6
    with adaptive(session):
        assert session.conf.get("spark.sql.adaptive.enabled") == "true"
    session.conf.set("spark.sql.adaptive.enabled", "false")
    with pytest.raises(ValueError), adaptive(session):
        raise ValueError
    assert session.conf.get("spark.sql.adaptive.enabled") == "false"


def test_state_is_one_key_for_many_cities(spark, tmp_path):
    """Python is called once a bucket, not once a city, and each city keeps its own values."""
    landing, root = str(tmp_path / "topic"), str(tmp_path / "out")
    cities = 3 * carry.BUCKETS
    for low in (0, 2):
        sent = spark.range(cities).selectExpr(f"explode(array({low}, {low + 1})) AS step", "id").selectExpr(
            "step + 10 * id AS seq", "concat('c', id) AS city", "cast(id % 90 + step AS int) AS aqi",
            "1D AS co", "1D AS no2", "1D AS pm10", "1D AS pm25", "1D AS temperature", "id AS timestamp",
            "1D AS latitude", "1D AS longitude",
        )
        topic.write_files(sent, landing)
        run(spark, landing, root, size=3)
    kept = spark.read.format("statestore").load(monitor.Tables(root).checkpoint)
    assert kept.count() <= carry.BUCKETS
    got = carry.read_state(spark, monitor.Tables(root).checkpoint).select("city", "values", "seq").collect()
    want = [(f"c{n}", [n % 90 + 1, n % 90 + 2, n % 90 + 3], 10 * n + 3) for n in range(cities)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_repeats_across_arrow_batches_of_one_bucket(spark):
    """Readings of a bucket's cities that come in several parts, some again, leave the last of each city."""
    import pandas as pd

    class State:
        exists, get, seen = False, None, None

        def update(self, value):
            self.exists, self.get = True, value

    def part(*rows):
        shown = {f.name: 0.0 for f in carry.LAST.fields}
        return pd.DataFrame([{"city": c, "seq": n, "aqi": v, **shown, "timestamp": n} for c, n, v in rows])

    state, update = State(), carry.remember(2)
    first = [part(("a", 5, 50), ("b", 1, 10)), part(("a", 3, 30), ("a", 5, 50), ("a", 4, 40))]
    (out,) = update((0,), iter(first), state)
    assert out.values.tolist() == [["a", [], carry.NO_NUMBER], ["b", [], carry.NO_NUMBER]]
    (out,) = update((0,), iter([part(("a", 4, 40), ("c", 9, 90)), part(("a", 7, 70))]), state)
    assert out.values.tolist() == [["a", [40, 50], 5], ["c", [], carry.NO_NUMBER]]
    (out,) = update((0,), iter([part(("b", 1, 10))]), state)
    assert out.values.tolist() == [["b", [10], 1]]
    cities, values, numbers = state.get[:3]
    assert dict(zip(cities, zip(values, numbers))) == {"a": ([50, 70], 7), "b": ([10], 1), "c": ([90], 9)}

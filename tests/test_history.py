import datetime as dt
import json
import random

import pytest
from data import reading, readings

from breezeline.functions.times import MAX_SECONDS
from breezeline.operators import history as H
from breezeline.schemas import HISTORY
from breezeline.sources import tables


def empty(spark):
    return spark.createDataFrame([], HISTORY)


def test_first_arrival_stays(spark):
    rows = readings(spark, [reading(3, "a", 30), reading(1, "a", 10), reading(2, "b", 20)])
    got = H.new_history(rows, empty(spark)).collect()
    assert sorted((r.city, r.aqi) for r in got) == [("a", 10), ("b", 20)]
    dup = H.duplicates(rows).collect()
    assert [(r.seq, r.aqi) for r in dup] == [(3, 30)]


def test_rows_already_there_are_skipped(spark):
    rows = readings(spark, [reading(1, "a", 10, 100), reading(2, "a", 20, 200)])
    there = H.new_history(rows.where("timestamp = 100"), empty(spark))
    assert [r.aqi for r in H.new_history(rows, there).collect()] == [20]
    assert [r.seq for r in H.duplicates(rows, there).collect()] == [1]


def test_what_the_table_refuses(spark):
    rows = readings(
        spark,
        [
            reading(0, "x" * 64, 1),
            reading(1, "x" * 65, 1),
            reading(2, "é" * 64, 1),
            reading(3, "a\u0000b", 1),
            reading(4, "a", 1, timestamp=MAX_SECONDS + 1),
            reading(5, "a", 1, timestamp=-(2**63)),
            reading(6, "a", 1, timestamp=MAX_SECONDS),
        ],
    )
    got = {r.seq: r.error for r in H.insert_rejects(rows).collect()}
    assert got == {
        1: "city exceeds 64 characters",
        3: "city holds a zero character",
        4: "timestamp out of range",
        5: "timestamp out of range",
    }
    assert H.new_history(rows, empty(spark)).count() == 3


def test_day_and_instant(spark):
    rows = readings(spark, [reading(0, "a", 1, 1709251199), reading(1, "a", 1, -1)])
    got = H.to_history(rows).selectExpr("date", "unix_seconds(timestamp) s").collect()
    assert [(r.date, r.s) for r in got] == [
        (dt.date(2024, 2, 29), 1709251199),
        (dt.date(1969, 12, 31), -1),
    ]


def test_latest_first_with_limit(spark):
    rows = readings(spark, [reading(i, c, i, 1000 + i) for i in range(30) for c in ("a", "b")])
    stored = H.new_history(rows, empty(spark))
    got = [r.aqi for r in H.city_history(stored, "a").collect()]
    assert got == list(range(29, 5, -1))
    assert [r.aqi for r in H.city_history(stored, "a", 2).collect()] == [29, 28]
    assert H.city_history(stored, "A").collect() == []
    bulk = H.latest_history(stored, 3).collect()
    assert sorted((r.city, r["rank"], r.aqi) for r in bulk) == [
        (c, k, 30 - k) for c in ("a", "b") for k in (1, 2, 3)
    ]


@pytest.mark.parametrize("limit", [0, -5, 1001])
def test_limit_bounds(spark, limit):
    with pytest.raises(ValueError, match="must be between 1 and 1000"):
        H.city_history(empty(spark), "a", limit)
    H.city_history(empty(spark), "a", limit, clamp=True)
    assert H.clamp_limit(limit) == (1 if limit < 1 else 1000)


def test_limits_inside_bounds(spark):
    for limit in (1, 1000):
        assert H.city_history(empty(spark), "a", limit).collect() == []


def test_reply_has_millis(spark):
    rows = H.to_history(readings(spark, [reading(0, "a", 7, 12)]))
    reply = json.loads(H.history_replies(rows).first().reply)
    assert reply["timestamp"] == 12000
    assert list(reply) == H.HISTORY_COLUMNS


def test_append_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "history")
    tables.create_history(spark, path)
    day = 86400
    first = readings(spark, [reading(0, "a", 1, 5), reading(1, "a", 2, 5), reading(2, "a", 3, day + 5)])
    second = readings(spark, [reading(3, "a", 4, 5), reading(4, "a", 5, 6), reading(5, "x" * 65, 6, 6)])

    def content():
        rows = tables.read_history(spark, path).collect()
        return sorted((r.city, r.aqi, str(r.date), r.batch_id) for r in rows)

    tables.append_history(first, path, 0)
    tables.append_history(second, path, 1)
    want = [
        ("a", 1, "1970-01-01", 0),
        ("a", 3, "1970-01-02", 0),
        ("a", 5, "1970-01-01", 1),
    ]
    assert content() == want
    for rows, batch in ((first, 0), (second, 1), (second, 1)):
        tables.append_history(rows, path, batch)
        assert content() == want
    tables.append_history(readings(spark, []), path, 2)
    assert content() == want
    assert tables.read_history(spark, path).where("city = 'a'").count() == 3


@pytest.mark.parametrize("listed", [1000, 1])
def test_only_days_of_the_batch_are_opened(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(tables, "LISTED_DAYS", listed)
    path, day = str(tmp_path / "history"), 86400
    tables.create_history(spark, path)
    first = [reading(0, "a", 1, 100 * day), reading(1, "a", 2, 200 * day)]
    tables.append_history(readings(spark, first), path, 0)
    if listed > 1:
        for file in tmp_path.glob("history/date=1970-04-11/*/*.parquet"):
            file.write_bytes(b"not parquet")
    second = [reading(2, "a", 3, 0), reading(3, "a", 4, 200 * day), reading(4, "b", 5, 200 * day)]
    tables.append_history(readings(spark, second), path, 1)
    got = tables.read_history(spark, path).where("date <> '1970-04-11'").select("city", "aqi").collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("a", 3), ("b", 5)]


@pytest.mark.parametrize("bound", [tables.BROADCAST_BYTES, 0])
def test_append_both_ways(spark, tmp_path, monkeypatch, bound):
    """Keys of a batch broadcast to the stored rows or shuffled with them: the same history."""
    monkeypatch.setattr(tables, "BROADCAST_BYTES", bound)
    path, rng = str(tmp_path / "history"), random.Random(5)
    tables.create_history(spark, path)
    rows = [reading(i, rng.choice("aab"), i, rng.randrange(30) * 40000) for i in range(120)]
    for n in range(3):
        tables.append_history(readings(spark, rows[n * 40 : n * 40 + 40]), path, n)
    want = {}
    for r in rows:
        want.setdefault((r[1], r[8]), r[2])
    got = tables.read_history(spark, path).selectExpr("city", "unix_seconds(timestamp) s", "aqi").collect()
    assert sorted((r.city, r.s, r.aqi) for r in got) == sorted((c, s, v) for (c, s), v in want.items())


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "history")
    tables.create_history(spark, path)
    tables.append_history(readings(spark, [reading(0, "a", 1, 5)]), path, 0)
    rows = H.first_rows(readings(spark, [reading(1, "a", 2, 5), reading(2, "b", 2, 5)])).persist()
    rows.count()
    new = H.not_yet(rows, tables.read_history(spark, path), few=True)
    assert [r.city for r in new.collect()] == ["b"]
    text = new._jdf.queryExecution().executedPlan().toString()
    stored = text[: text.index("InMemoryTableScan")] if "InMemoryTableScan" in text else text
    assert "Exchange hashpartitioning" not in stored
    rows.unpersist()


def stored_days(spark, path, days):
    """A history with one row of "often" a day and one of "rare" on the oldest day."""
    tables.create_history(spark, path)
    rows = [reading(i, "often", i, i * 86400) for i in range(days)] + [reading(days, "rare", 7, 60)]
    tables.append_history(readings(spark, rows), path, 0)


def opened(df):
    return {f.split("date=")[1].split("/")[0] for f in df.inputFiles()}


def test_lookup_opens_the_newest_days_only(spark, tmp_path):
    for days in (20, 60):
        path = str(tmp_path / f"h{days}")
        stored_days(spark, path, days)
        got = tables.city_history(spark, path, "often", 5)
        assert [r.aqi for r in got.collect()] == list(range(days - 1, days - 6, -1))
        assert len(opened(got)) == 8
        rare = tables.city_history(spark, path, "rare", 5)
        assert [r.aqi for r in rare.collect()] == [7] and len(opened(rare)) == days
        assert tables.city_history(spark, path, "none").collect() == []
        whole = tables.read_history(spark, path)
        assert tables.city_history(spark, path, "often", 1000).collect() == H.city_history(whole, "often", 1000).collect()


def test_lookup_in_odd_histories(spark, tmp_path):
    path = str(tmp_path / "h")
    assert tables.city_history(spark, path, "a").collect() == []
    tables.create_history(spark, path)
    assert tables.city_history(spark, path, "a").collect() == []
    with pytest.raises(ValueError, match="must be between 1 and 1000"):
        tables.city_history(spark, path, "a", 0)
    late = [reading(0, "a", 1, 253402300800 + 5), reading(1, "a", 2, 5), reading(2, "a", 3, -86400 * 365)]
    tables.append_history(readings(spark, late), path, 0)
    assert [r.aqi for r in tables.city_history(spark, path, "a", 0, clamp=True).select("aqi").collect()] == [1]
    assert [r.aqi for r in tables.city_history(spark, path, "a").select("aqi").collect()] == [1, 2, 3]

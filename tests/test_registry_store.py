"""Versions of the registry: what readers and writers of it may rely on."""

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from breezeline.operators import messages
from breezeline.operators import registry as R
from breezeline.schemas import REGISTRY, RESPONSE
from breezeline.sources import files, topic
from breezeline.sources.registry_store import RegistryStore
from breezeline.sources.responses import stream_responses
from breezeline.streaming import poller

AT = dt.datetime(2024, 1, 1)


def entries(spark, *flags):
    return spark.createDataFrame([(i, n, "c", "k", v, AT) for i, (n, v) in enumerate(flags)], REGISTRY)


def changes(spark, *rows):
    days = [(n, v, None if d is None else AT + dt.timedelta(days=d)) for n, v, d in rows]
    return spark.createDataFrame(days, "name string, valid_entry boolean, flag_at timestamp")


def flags(df):
    return {r["name"]: r["valid_entry"] for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    made = RegistryStore(spark, str(tmp_path / "registry"))
    made.create(entries(spark, ("a", True), ("b", True), ("c", False), ("d", None)))
    return made


def test_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "deep" / "file")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create(spark, path, f"text é {i}"), range(8)))
    assert sum(won) == 1
    assert files.read(spark, path) == f"text é {won.index(True)}"
    assert files.names(spark, str(tmp_path / "deep")) == ["file"]
    assert files.names(spark, str(tmp_path / "none")) == []


def test_newest_flag_wins(spark, store):
    first = store.commit()
    assert (first.version, first.entries, first.valid, first.affected) == (0, 4, 2, 0)
    new = store.change(changes(spark, ("a", False, 2), ("a", True, 1), ("c", True, 1), ("x", True, 9), ("b", False, -1)))
    assert flags(store.read()) == {"a": False, "b": True, "c": True, "d": None}
    assert (new.version, new.valid, new.affected) == (1, 2, 3)  # x is no entry; b is named, its flag is newer
    store.change(changes(spark, ("a", True, 2)))  # as old as the flag: invalid stays
    assert flags(store.read())["a"] is False
    store.change(changes(spark, ("a", True, 3), ("c", True, 5), ("c", False, 5)))
    assert flags(store.read()) == {"a": True, "b": True, "c": False, "d": None}
    assert flags(store.read(0)) == {"a": True, "b": True, "c": False, "d": None}
    assert flags(store.read(1))["a"] is False


def test_reload_keeps_newer_flags(spark, store):
    store.change(changes(spark, ("a", False, 5)))
    incoming = entries(spark, ("a", True), ("b", False), ("e", True))
    dated = incoming.withColumn("flag_at", F.when(F.col("name") == "b", F.lit(AT + dt.timedelta(days=7))))
    store.reload(dated)
    # a: the stored flag is newer; b: the incoming one is; e is new; c and d are gone
    assert flags(store.read()) == {"a": False, "b": False, "e": True}


def test_tagged_change_is_made_once(spark, store):
    first = store.change(changes(spark, ("a", False, 1)), tag="batch-0")
    store.change(changes(spark, ("a", True, 2)))
    assert store.change(changes(spark, ("a", False, 3)), tag="batch-0") == first
    assert flags(store.read())["a"] is True
    assert store.versions() == [0, 1, 2]


def test_pin_keeps_the_version(spark, store):
    assert store.pin("poll-0") == 0
    store.change(changes(spark, ("a", False, 1)))
    assert store.pin("poll-0") == 0 and store.pin("poll-1") == 1


def test_writers_at_one_time_lose_nothing(spark, store):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: store.change(changes(spark, (n, True, 1)), tag=n), ["a", "b", "c", "d"]))
    assert flags(store.read()) == {"a": True, "b": True, "c": True, "d": True}
    assert store.versions() == [0, 1, 2, 3, 4]


def test_expire_keeps_the_newest(spark, store):
    for day in range(1, 4):
        store.change(changes(spark, ("a", day % 2 == 0, day)))
    assert store.expire(2) == 2 and store.versions() == [2, 3]
    assert flags(store.read())["a"] is False
    store.change(changes(spark, ("a", True, 9)))
    assert store.commit().version == 4


def test_no_registry_and_null_rows(spark, tmp_path):
    empty = RegistryStore(spark, str(tmp_path / "r"))
    with pytest.raises(LookupError):
        empty.read()
    empty.create(entries(spark))
    assert empty.commit().entries == 0
    empty.change(changes(spark, (None, None, None), ("a", None, None)))
    assert empty.read().collect() == []
    with pytest.raises(ValueError):
        empty.create(entries(spark))
    newest = R.newest_flags(changes(spark, ("a", True, None), ("a", None, 1), ("a", True, 1)))
    assert [tuple(r)[:2] for r in newest.collect()] == [("a", None)]


def test_city_enabled_again_is_polled_again(spark, tmp_path, store):
    landing, root = str(tmp_path / "landed"), str(tmp_path / "out")
    good, unknown = '{"status":"ok","data":{"aqi":5}}', '{"status":"error","data":"Unknown station"}'
    polls = [
        [(0, "a", 200, unknown), (1, "b", 200, good)],
        [(2, "a", 200, good), (3, "b", 200, good)],
        [(4, "a", 200, good), (5, "c", 200, good)],
        [(6, "a", 200, good), (7, "b", 200, unknown), (8, "z", 200, good)],
    ]
    for number, rows in enumerate(polls):
        if number == 2:
            store.change(spark.createDataFrame([("a", True)], "name string, valid_entry boolean"))
        spark.createDataFrame(rows, RESPONSE).write.mode("append").parquet(landing)
        poller.run_poller(stream_responses(spark, landing, "parquet"), root, store).awaitTermination()
    events = messages.readings(messages.decode(topic.read_files(spark, f"{root}/topic")))
    assert sorted(r.seq for r in events.collect()) == [1, 3, 4, 6]
    got = {r["batch_id"]: r for r in poller.read_reloads(spark, root).collect()}
    assert [(got[i].old_count, got[i].new_count, got[i].rows_affected) for i in range(4)] == [(0, 2, 1), (2, 1, 0), (1, 2, 0), (2, 2, 1)]
    assert got[0].label == "Cities loaded: 0 → 2 (scheduler now active!)"
    assert got[2].label == "Cities reloaded: 1 → 2 (change: +1)"
    assert flags(store.read()) == {"a": True, "b": False, "c": False, "d": None}


def test_repeated_poll_sees_the_same_registry(spark, tmp_path, store):
    root = str(tmp_path / "out")
    batch = spark.createDataFrame([(0, "a", 200, '{"status":"error","data":"Unknown station"}')], RESPONSE)
    for _ in range(2):
        poller.write_polled(batch, 0, root, store)
        store.change(spark.createDataFrame([("a", True)], "name string, valid_entry boolean"))
    assert [(r.name, r.rows_affected) for r in poller.read_invalid(spark, root).collect()] == [("a", 1)]
    assert flags(store.read())["a"] is True
    tags = [store.commit(v).tag for v in store.versions()]
    assert tags.count("poll-0") == 1
    assert json.loads(files.read(spark, f"{store.root}/commits/{1:020d}.json"))["tag"] == "poll-0"

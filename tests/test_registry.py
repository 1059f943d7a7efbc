import datetime as dt

from data import reading, readings

from breezeline.operators import registry as R
from breezeline.schemas import REGISTRY
from breezeline.sources.registry import read_registry, read_seed, write_registry

AT = dt.datetime(2024, 1, 1)


def registry(spark, *rows):
    return spark.createDataFrame(
        [(i, n, "country", "continent", v, AT) for i, (n, v) in enumerate(rows)], REGISTRY
    )


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def flags(df):
    return {r.name: r.valid_entry for r in df.collect()}


def test_only_true_is_valid(spark):
    reg = registry(spark, ("b", True), ("c", False), ("a", True), ("d", None))
    got = R.valid_cities_by_name(reg)
    assert [r.name for r in got.collect()] == ["a", "b"]
    assert got.columns == REGISTRY.names


def test_readings_of_valid_cities(spark):
    reg = registry(spark, ("a", True), ("b", False), ("c", None))
    cities = ["a", "b", "c", "d", "a", "a", "a"]
    rows = readings(spark, [reading(i, c, 1) for i, c in enumerate(cities)])
    for kw in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "split_rows": 2}):
        got = R.of_valid_cities(rows, reg, **kw)
        assert sorted(r.seq for r in got.collect()) == [0, 4, 5, 6]
        assert got.columns == rows.columns


def test_marking_invalid(spark):
    reg = registry(spark, ("a", True), ("b", False), ("c", None), ("d", True))
    bad = names(spark, "a", "a", "b", "nowhere")
    assert flags(R.mark_invalid(reg, bad)) == {"a": False, "b": False, "c": None, "d": True}
    report = {r.name: (r.rows_affected, r.error) for r in R.invalidation_report(reg, bad).collect()}
    assert report == {
        "a": (1, None),
        "b": (1, None),
        "nowhere": (0, "city not found in database"),
    }


def test_seed_keeps_existing_and_first(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text("name,country,continent\na,new,new\nz,first,x\nz,second,x\ny,,\n")
    reg = registry(spark, ("a", False))
    got = R.insert_seed(reg, read_seed(spark, str(path))).collect()
    assert sorted((r.name, r.country, r.valid_entry) for r in got) == sorted(
        [("a", "country", False), ("z", "first", True), ("y", None, True)], key=lambda t: t[0]
    )
    assert all(r.created_at is not None for r in got)


def test_reload_labels(spark):
    none = registry(spark, ("a", False))
    two = registry(spark, ("a", True), ("b", True), ("c", None))
    three = registry(spark, ("a", True), ("b", True), ("c", True))

    def summary(old, new):
        r = R.reload_summary(old, new).first()
        return (r.old_count, r.new_count, r.change, r.label)

    assert summary(none, two) == (0, 2, 2, "Cities loaded: 0 → 2 (scheduler now active!)")
    assert summary(two, three) == (2, 3, 1, "Cities reloaded: 2 → 3 (change: +1)")
    assert summary(three, two) == (3, 2, -1, "Cities reloaded: 3 → 2 (change: -1)")
    assert summary(two, two) == (2, 2, 0, "Cities reloaded: 2 (no changes)")
    assert summary(none, none) == (0, 0, 0, "Cities reloaded: 0 (no changes)")


def test_snapshot_round_trip(spark, tmp_path):
    reg = registry(spark, ("a", True), ("b", None))
    write_registry(reg, str(tmp_path / "r"))
    back = read_registry(spark, str(tmp_path / "r"))
    assert sorted(back.collect()) == sorted(reg.collect())


def test_seed_rows_keep_the_order_of_files_and_lines(spark, tmp_path):
    """Large files first, so that Spark gathers splits in another order than that of the names."""
    lines = {"a.csv": 40, "b.csv": 4000, "c.csv": 900}
    for n, (name, count) in enumerate(lines.items()):
        rows = "".join(f"n{i % 50},{name}-{i},x\n" for i in range(n, count))
        (tmp_path / name).write_text("name,country,continent\n" + rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.name: r.country for r in R.seed_rows_to_add(registry(spark), read_seed(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {}
    for n, (name, count) in enumerate(lines.items()):
        for i in range(n, count):
            want.setdefault(f"n{i % 50}", f"{name}-{i}")
    assert got == want

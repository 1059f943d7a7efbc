import random

import pytest
from data import brute_force, reading, readings, sequence

from breezeline.operators import scoring
from breezeline.operators.rolling import rolling_ema


def outcomes(spark, city, values, **kw):
    scored = scoring.score(sequence(spark, city, values))
    rows = scoring.outcomes(scored, **kw).orderBy("seq", "position").collect()
    return [(r.seq, r.outcome, r.details) for r in rows]


def kinds(spark, values, **kw):
    return [(s, o) for s, o, _ in outcomes(spark, "c", values, **kw)]


def test_normal_reading(spark):
    assert outcomes(spark, "oslo", [50]) == [
        (0, "NORMAL", "[oslo] AQI: 50 (EMA: N/A, T: 21.0°C)")
    ]


def test_unhealthy_reading(spark):
    assert outcomes(spark, "lima", [160]) == [
        (
            0,
            "UNHEALTHY",
            "[lima] ALERT 1: Unhealthy AQI! Value: 160 (threshold: 150) | PM2.5: 13.0, PM10: 11.0",
        )
    ]


def test_spike(spark):
    assert outcomes(spark, "quito", [50, 100])[1] == (
        1,
        "SPIKE",
        "[quito] ALERT 2: Sudden spike! Current: 100 vs EMA: 50 (+100%, threshold: 65)",
    )


def test_both_alerts_in_order(spark):
    assert kinds(spark, [100, 200]) == [(0, "NORMAL"), (1, "UNHEALTHY"), (1, "SPIKE")]


def test_limits_are_strict(spark):
    assert kinds(spark, [150]) == [(0, "NORMAL")]
    # 50 * 1.3 is exactly 65.0
    assert kinds(spark, [50, 65]) == [(0, "NORMAL"), (1, "NORMAL")]
    assert kinds(spark, [50, 66]) == [(0, "NORMAL"), (1, "SPIKE")]


def test_zero_baseline(spark):
    assert outcomes(spark, "z", [0, 5])[1][2] == (
        "[z] ALERT 2: Sudden spike! Current: 5 vs EMA: 0 (+2147483647%, threshold: 0)"
    )


def test_huge_and_negative_values_do_not_overflow(spark):
    found = kinds(spark, [1, 2147483647, -2147483648, -5, 3])
    assert found[1:3] == [(1, "UNHEALTHY"), (1, "SPIKE")]
    assert len({s for s, _ in found}) == 5


def test_percent_is_cut_toward_zero(spark):
    # before-average of the third is 83.33, and 200 is 140 % above it
    assert "vs EMA: 83 (+140%, threshold: 108)" in outcomes(spark, "c", [50, 100, 200])[-1][2]


def test_parameters(spark):
    assert kinds(spark, [60, 70], threshold=60, multiplier=2.0) == [(0, "NORMAL"), (1, "UNHEALTHY")]


def test_alerts_leave_out_normal(spark):
    scored = scoring.score(sequence(spark, "c", [50, 100, 100]))
    rows = scoring.alerts(scored).orderBy("seq").collect()
    assert [(r.seq, r.alert_type) for r in rows] == [(1, "SPIKE")]


def averages(df):
    return {r.seq: (r.ema_before, r.ema_after) for r in df.collect()}


def test_warm_up_and_eviction(spark):
    got = averages(scoring.score(sequence(spark, "c", [50, 100])))
    assert got == {0: (None, 50.0), 1: (50.0, 2 / 3 * 100 + (1 - 2 / 3) * 50.0)}
    values = [500, *range(10, 120, 10)]
    got = averages(scoring.score(sequence(spark, "c", values)))
    assert got == brute_force([(i, "c", v) for i, v in enumerate(values)], 10)


def test_order_is_arrival_not_event_time(spark):
    late_first = [reading(0, "c", 100, timestamp=200), reading(1, "c", 50, timestamp=100)]
    assert averages(scoring.score(readings(spark, late_first)))[1][0] == 100.0


def uneven(seed, cities=7, count=600):
    """Rows of which a third belong to one city, arriving in bursts with gaps."""
    rng = random.Random(seed)
    rows, seq = [], 5
    for _ in range(count):
        seq += rng.choice([1, 1, 1, 1, 2, 400])
        city = "hot" if rng.random() < 0.34 else f"c{rng.randrange(cities)}"
        rows.append((seq, city, rng.randrange(-20, 400)))
    return rows


@pytest.mark.parametrize(
    "size,split_rows", [(1, 4), (10, 1), (10, 4), (10, 50), (10, 1_000_000), (17, 4)]
)
def test_chunks_do_not_change_averages(spark, size, split_rows):
    rows = uneven(size)
    df = spark.createDataFrame(rows, "seq long, city string, aqi int")
    got = averages(rolling_ema(df, size, split_rows=split_rows))
    assert got == brute_force(rows, size)


@pytest.mark.parametrize("size,split_rows", [(10, 3), (10, 1_000_000), (20, 3)])
def test_carried_values_come_first(spark, size, split_rows):
    rows = uneven(size + 100, count=200)
    carried = {"hot": list(range(100, 100 + size)), "c0": [7], "c1": [1, 2], "absent": [3]}
    df = spark.createDataFrame(rows, "seq long, city string, aqi int")
    # their numbers overlap those of the rows, and must not matter
    before = spark.createDataFrame(
        [(c, i, v) for c, vs in carried.items() for i, v in enumerate(vs)],
        "city string, seq long, aqi int",
    )
    got = averages(rolling_ema(df, size, carried=before, split_rows=split_rows))
    assert got == brute_force(rows, size, carried)


def test_nothing_in_nothing_out(spark):
    assert scoring.score(readings(spark, [])).count() == 0


def test_window_size_is_checked(spark):
    with pytest.raises(ValueError):
        scoring.score(readings(spark, []), size=0)


@pytest.mark.parametrize("size", [16, 17, 1001])
@pytest.mark.parametrize("split_rows", [1_000_000, 2])
def test_missing_values_take_no_part(spark, size, split_rows):
    values = [100, None, 50, None, None, 80]
    got = rolling_ema(sequence(spark, "c", values), size, split_rows=split_rows).orderBy("seq").collect()
    plain = rolling_ema(sequence(spark, "c", [100, 50, 80]), size).orderBy("seq").collect()
    kept = [(r.ema_before, r.ema_after) for r in got if r.aqi is not None]
    assert kept == [(r.ema_before, r.ema_after) for r in plain]
    assert all(r.ema_before is None and r.ema_after is None for r in got if r.aqi is None)

import json

import pytest
from data import responses

from breezeline.operators import responses as R

FULL = {
    "status": "ok",
    "data": {
        "aqi": 71,
        "idx": 808,
        "city": {"geo": [-12.25, 130.5], "name": "N", "url": "u", "location": "l"},
        "dominentpol": "pm25",
        "iaqi": {
            "co": {"v": 0.75}, "no2": {"v": 6.5}, "pm10": {"v": 33.0}, "pm25": {"v": 71.0}, "t": {"v": 29.25},
        },
        "time": {"s": "s", "tz": "+09:30", "v": 1700000123, "iso": "i"},
    },
}


def ok(data):
    return json.dumps({"status": "ok", "data": data})


def classified(spark, *bodies):
    rows = [("c", 200, b) if not isinstance(b, tuple) else b for b in bodies]
    return R.classify(responses(spark, rows))


def errors(spark, *bodies):
    return [r.error for r in classified(spark, *bodies).orderBy("seq").collect()]


def test_full_response(spark):
    df = classified(spark, ("darwin", 200, json.dumps(FULL, indent=4)))
    assert [tuple(r)[1:] for r in R.events(df).collect()] == [
        ("darwin", 71, 0.75, 6.5, 33.0, 71.0, 29.25, 1700000123, -12.25, 130.5)
    ]
    assert R.rejects(df).count() == 0


def test_missing_values_are_zero(spark):
    df = classified(spark, ok({"aqi": 50}), ok({}), ok({"aqi": None, "city": {"geo": [1]}}))
    got = [tuple(r)[2:] for r in R.events(df).orderBy("seq").collect()]
    zeros = (0.0,) * 5
    assert got == [
        (50, *zeros, 0, 0.0, 0.0),
        (0, *zeros, 0, 0.0, 0.0),
        (0, *zeros, 0, 1.0, 0.0),
    ]


def test_unknown_station_invalidates(spark):
    df = classified(
        spark,
        ("bad", 200, '{"status":"error","data":"Unknown station"}'),
        ("bad", 200, '{"status":"error","data":"Unknown station"}'),
        ("other", 200, '{"status":"error","data":"Too many calls"}'),
    )
    got = [(r.error, r.invalidates) for r in df.orderBy("seq").collect()]
    assert got == [
        ("unknown station", True),
        ("unknown station", True),
        ("API error: Too many calls", False),
    ]
    assert [r.name for r in R.invalid_cities(df).collect()] == ["bad"]


LADDER = [
    (("", 200, json.dumps(FULL)), "city name cannot be empty"),
    (("", 500, "x"), "city name cannot be empty"),
    (("c", None, None), "failed to execute request"),
    (("c", 500, "Internal Server Error"), "non-2xx response: 500 - Internal Server Error"),
    (("c", 199, ""), "non-2xx response: 199 - "),
    (("c", 300, None), "non-2xx response: 300 - "),
    (("c", 299, json.dumps(FULL)), None),
    (("c", 200, None), "failed to read response body"),
    ("", "Error parsing AQI JSON"),
    ("not json", "Error parsing AQI JSON"),
    ("[1]", "Error parsing AQI JSON"),
    ("3", "Error parsing AQI JSON"),
    ('"ok"', "Error parsing AQI JSON"),
    ('{"status":5}', "Error parsing AQI JSON"),
    ('{"status":{"a":1}}', "Error parsing AQI JSON"),
    ('{"status":"ok","data":{"aqi":1}} x', "Error parsing AQI JSON"),
    ('{"status":"ok","data":{"aqi":1}}{"status":"ok"}', "Error parsing AQI JSON"),
    ('{"status":"ok","data":{"aqi":1}},{"a":1}', "Error parsing AQI JSON"),
    ('{"status":"ok","data":{"aqi":1}}],[{}', "Error parsing AQI JSON"),
    ('{"status":"ok","data":{"aqi":1}', "Error parsing AQI JSON"),
    (' \n{"status":"ok","data":{"aqi":1}}\t ', None),
    ("null", "API returned non-ok status: "),
    ("{}", "API returned non-ok status: "),
    ('{"status":null,"data":{}}', "API returned non-ok status: "),
    ('{"status":"OK","data":{}}', "API returned non-ok status: OK"),
    ('{"status":"error","data":null}', "API error: "),
    ('{"status":"error","data":""}', "API error: "),
    ('{"status":"error"}', "API returned error status without message"),
    ('{"status":"error","data":{"a":1}}', "API returned error status without message"),
    ('{"status":"error","data":7}', "API returned error status without message"),
    ('{"status":"ok","data":"maintenance"}', "API error: maintenance"),
    ('{"status":"ok","data":null}', "API error: "),
    ('{"status":"ok"}', "error parsing AQI data"),
    ('{"status":"ok","data":[1]}', "error parsing AQI data"),
    ('{"status":"ok","data":5}', "error parsing AQI data"),
]


def test_ladder(spark):
    got = errors(spark, *[body for body, _ in LADDER])
    assert list(zip([b for b, _ in LADDER], got)) == LADDER


BAD_DATA = [
    '{"aqi":"-"}', '{"aqi":"42"}', '{"aqi":42.0}', '{"aqi":1e2}', '{"aqi":true}', '{"aqi":[1]}',
    '{"aqi":2147483648}', '{"idx":"1"}', '{"idx":1.5}', '{"idx":99999999999999999999}',
    '{"city":"x"}', '{"city":[1]}', '{"city":{"geo":{}}}', '{"city":{"geo":"x"}}', '{"city":{"geo":["1",2]}}',
    '{"city":{"geo":[1,{}]}}', '{"city":{"name":1}}', '{"city":{"url":true}}', '{"city":{"location":[]}}',
    '{"dominentpol":3}', '{"iaqi":[]}', '{"iaqi":{"co":5}}', '{"iaqi":{"no2":{"v":"1"}}}',
    '{"iaqi":{"pm10":{"v":[]}}}', '{"iaqi":{"pm25":"x"}}', '{"iaqi":{"t":{"v":1e400}}}',
    '{"time":5}', '{"time":{"v":"1"}}', '{"time":{"v":1.0}}', '{"time":{"s":1}}', '{"time":{"tz":1}}',
    '{"time":{"iso":1}}', '{"time":{"v":99999999999999999999}}',
]
GOOD_DATA = [
    '{"aqi":-5}', '{"aqi":2147483647}', '{"idx":2147483648}', '{"idx":null,"city":null,"iaqi":null,"time":null}',
    '{"city":{"geo":null}}', '{"city":{"geo":[]}}', '{"city":{"geo":[1,2,"x",{}]}}', '{"city":{"geo":[null,2e0]}}',
    '{"city":{"name":null}}', '{"iaqi":{"co":null}}', '{"iaqi":{"co":{}}}', '{"iaqi":{"co":{"v":null}}}',
    '{"iaqi":{"co":{"v":7}}}', '{"iaqi":{"co":{"v":12345678901234567890}}}', '{"iaqi":{"so2":"any"}}',
    '{"time":{"v":9223372036854775807}}', '{"attributions":[1]}',
]


@pytest.mark.parametrize("bodies,error", [(BAD_DATA, "error parsing AQI data"), (GOOD_DATA, None)])
def test_data_types(spark, bodies, error):
    got = errors(spark, *[f'{{"status":"ok","data":{b}}}' for b in bodies])
    assert [b for b, e in zip(bodies, got) if e != error] == []


def test_last_of_repeated_keys(spark):
    df = classified(spark, '{"status":"error","data":{"aqi":1,"aqi":2},"status":"ok"}')
    assert [r.aqi for r in R.events(df).collect()] == [2]


def test_landed_files(spark, tmp_path):
    from breezeline.sources.responses import read_responses

    path = tmp_path / "landed"
    path.mkdir()
    rows = [{"seq": 1, "city": "a", "status_code": 200, "body": json.dumps(FULL)}, {"seq": 2, "city": "a"}]
    (path / "x.json").write_text("\n".join(json.dumps(r) for r in rows))
    df = R.classify(read_responses(spark, str(path)))
    assert [(r.seq, r.error) for r in df.orderBy("seq").collect()] == [
        (1, None),
        (2, "failed to execute request"),
    ]

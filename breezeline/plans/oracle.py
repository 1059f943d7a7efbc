"""The same queries as plain SQL for DuckDB, on the same tables.

Written from the meaning of each query, not from its Spark plan.
"""

from __future__ import annotations

from .catalog import CITY
from .inputs import BODIES, NO_CITY, NO_RESPONSE, SERVER_ERROR, VALUES
from .streams import ENABLED_BEFORE, SLICES

READING = [
    "city", "aqi", "co", "no2", "pm10", "pm25", "temperature", "timestamp", "latitude", "longitude",
]
HISTORY = [
    "city", "latitude", "longitude", "aqi", "co", "no2", "pm10", "pm25", "temperature", "timestamp",
]
STATUS = ["co", "no2", "pm10", "pm25", "temperature", "timestamp"]


def _list(columns: list[str], prefix: str = "") -> str:
    return ", ".join(f'{prefix}"{c}"' for c in columns)


M = """m AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS city, CAST(floor(value) AS INTEGER) AS aqi,
         value / 4 AS co, value / 8 AS no2, value / 2 AS pm10, value AS pm25,
         value / 4 - 10 AS temperature, epoch_us(ts) // 1000000 AS "timestamp",
         CAST(45.5 AS DOUBLE) AS latitude, CAST(9.25 AS DOUBLE) AS longitude
  FROM events)"""
DAILY = """d AS (
  SELECT * REPLACE (CAST("timestamp" // 86400 * 86400 AS BIGINT) AS "timestamp") FROM m)"""
FIRST = """f AS (
  SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY city, "timestamp" ORDER BY seq) = 1)"""
HIST = """h AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY city, "timestamp" ORDER BY seq) = 1)"""
TAKEN = """taken AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS city,
         CAST(epoch_us(ts) // 1000000 // 86400 * 86400 AS BIGINT) AS "timestamp"
  FROM events WHERE event_type = 'error')"""
REG = """r AS (
  SELECT CAST(c_custkey AS INTEGER) AS id, CAST(c_custkey AS VARCHAR) AS name, n_name AS country,
         r_name AS continent,
         CASE WHEN c_acctbal >= 0 THEN true WHEN c_mktsegment <> 'MACHINERY' THEN false END
           AS valid_entry,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _fold(q: str) -> str:
    a = f"(CAST(2.0 AS DOUBLE) / (len({q}) + 1))"
    step = f"lambda acc, x: {a} * x + (CAST(1.0 AS DOUBLE) - {a}) * acc"
    return f"CASE WHEN len({q}) > 0 THEN list_reduce({q}, {step}, CAST({q}[1] AS DOUBLE)) END"


def _scored(size: int = 10) -> str:
    return f"""w AS (
  SELECT *,
    list(aqi) OVER (PARTITION BY city ORDER BY seq ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING) q0,
    list(aqi) OVER (PARTITION BY city ORDER BY seq
                    ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) q1
  FROM m),
s AS (SELECT * EXCLUDE (q0, q1), {_fold("q0")} AS ema_before, {_fold("q1")} AS ema_after FROM w)"""


def _int_text(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(CAST(LEAST(trunc({x}), 2147483647) AS INTEGER) AS VARCHAR) END"


def _outcomes(threshold: int = 150, multiplier: float = 1.3) -> str:
    limit = f"(ema_before * CAST({multiplier} AS DOUBLE))"
    rise = (
        "CASE WHEN ema_before = 0 THEN '2147483647' ELSE "
        + _int_text("(aqi - ema_before) / ema_before * 100")
        + " END"
    )
    return f"""raised AS (
  SELECT *, aqi > {threshold} AS u, coalesce(aqi > {limit}, false) AS k FROM s),
o AS (
  SELECT seq, city, aqi, ema_before, 0 AS position, 'UNHEALTHY' AS outcome,
    '[' || city || '] ALERT 1: Unhealthy AQI! Value: ' || aqi || ' (threshold: {threshold}) | PM2.5: '
    || CAST(pm25 AS VARCHAR) || ', PM10: ' || CAST(pm10 AS VARCHAR) AS details
  FROM raised WHERE u
  UNION ALL
  SELECT seq, city, aqi, ema_before, CASE WHEN u THEN 1 ELSE 0 END, 'SPIKE',
    '[' || city || '] ALERT 2: Sudden spike! Current: ' || aqi || ' vs EMA: '
    || {_int_text("ema_before")} || ' (+' || {rise} || '%, threshold: ' || {_int_text(limit)} || ')'
  FROM raised WHERE k
  UNION ALL
  SELECT seq, city, aqi, ema_before, 0, 'NORMAL',
    '[' || city || '] AQI: ' || aqi || ' (EMA: ' || coalesce({_int_text("ema_before")}, 'N/A')
    || ', T: ' || CAST(temperature AS VARCHAR) || '°C)'
  FROM raised WHERE NOT u AND NOT k)"""


ALERTS = (
    "SELECT seq, city, aqi, ema_before, outcome AS alert_type, details FROM o"
    " WHERE outcome <> 'NORMAL'"
)
OUTCOMES = "SELECT seq, city, aqi, ema_before, position, outcome, details FROM o"
EMA = "SELECT seq, city, aqi, ema_before, ema_after FROM s"
LATEST = f"""st AS (
  SELECT city, aqi AS "currentAqi", ema_after AS ema, {_list(STATUS)}
  FROM s QUALIFY row_number() OVER (PARTITION BY city ORDER BY seq DESC) = 1)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str | None, **values: str) -> str:
    if template is None:
        return "CAST(NULL AS VARCHAR)"
    text = _quoted(template)
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', CAST({value} AS VARCHAR))"
    return text


def _one_of(templates: list[str | None], **values: str) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {_filled(t, **values)}" for i, t in enumerate(templates)
    )
    return f"CASE seq % {len(templates)} {whens} END"


RESP = f"""resp AS (
  SELECT seq, CASE WHEN seq % {len(BODIES)} = {NO_CITY} AND aqi > 50 THEN '' ELSE city END AS city,
    CAST(CASE seq % {len(BODIES)} WHEN {NO_RESPONSE} THEN NULL WHEN {SERVER_ERROR} THEN 500
         ELSE 200 END AS INTEGER) AS status_code,
    {_one_of(BODIES, a="aqi", e='"timestamp"')} AS body
  FROM m)"""

_NUMBER = "('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE')"


def _type_ok(path: str, types: str) -> str:
    return f"coalesce(json_type(j, '{path}') IN {types}, true)"


def _data_ok() -> str:
    checks = ["json_type(j, '$.data') = 'OBJECT'"]
    objects = ["$.data.city", "$.data.iaqi", "$.data.time"]
    objects += [f"$.data.iaqi.{p}" for p in ("co", "no2", "pm10", "pm25", "t")]
    checks += [_type_ok(p, "('OBJECT', 'NULL')") for p in objects]
    checks.append(_type_ok("$.data.city.geo", "('ARRAY', 'NULL')"))
    wholes = ["$.data.aqi", "$.data.idx", "$.data.time.v"]
    checks += [_type_ok(p, "('UBIGINT', 'BIGINT', 'NULL')") for p in wholes]
    doubles = ["$.data.city.geo[0]", "$.data.city.geo[1]"]
    doubles += [f"$.data.iaqi.{p}.v" for p in ("co", "no2", "pm10", "pm25", "t")]
    checks += [_type_ok(p, _NUMBER[:-1] + ", 'NULL')") for p in doubles]
    texts = ["$.data.dominentpol", "$.data.city.name", "$.data.city.url", "$.data.city.location"]
    texts += ["$.data.time.s", "$.data.time.tz", "$.data.time.iso"]
    checks += [_type_ok(p, "('VARCHAR', 'NULL')") for p in texts]
    checks.append(
        "coalesce(TRY_CAST(json_extract_string(j, '$.data.aqi') AS HUGEINT)"
        " BETWEEN -2147483648 AND 2147483647, true)"
    )
    return "(" + " AND ".join(f"coalesce({c}, false)" for c in checks) + ")"


LADDER = f"""parsed AS (
  SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM resp),
typed AS (
  SELECT *, json_type(j) AS tj, json_type(j, '$.status') AS ts, json_type(j, '$.data') AS td,
    coalesce(json_extract_string(j, '$.status'), '') AS st,
    coalesce(json_extract_string(j, '$.data'), '') AS txt FROM parsed),
laddered AS (
  SELECT *, CASE
    WHEN coalesce(city, '') = '' THEN 'city name cannot be empty'
    WHEN status_code IS NULL THEN 'failed to execute request'
    WHEN status_code NOT BETWEEN 200 AND 299 THEN 'non-2xx response: ' || status_code || ' - ' || body
    WHEN body IS NULL THEN 'failed to read response body'
    WHEN j IS NULL OR tj NOT IN ('OBJECT', 'NULL') OR coalesce(ts NOT IN ('VARCHAR', 'NULL'), false)
      THEN 'Error parsing AQI JSON'
    WHEN st = 'error' AND td IN ('VARCHAR', 'NULL') AND txt = 'Unknown station' THEN 'unknown station'
    WHEN st = 'error' AND td IN ('VARCHAR', 'NULL') THEN 'API error: ' || txt
    WHEN st = 'error' THEN 'API returned error status without message'
    WHEN st <> 'ok' THEN 'API returned non-ok status: ' || st
    WHEN td IN ('VARCHAR', 'NULL') THEN 'API error: ' || txt
    WHEN NOT {_data_ok()} THEN 'error parsing AQI data' END AS error
  FROM typed)"""


def _number(path: str, type_: str = "DOUBLE") -> str:
    return f"coalesce(CAST(json_extract_string(j, '{path}') AS {type_}), CAST(0 AS {type_}))"


EVENTS = f"""ev AS (
  SELECT seq, city, {_number("$.data.aqi", "INTEGER")} AS aqi,
    {_number("$.data.iaqi.co.v")} AS co, {_number("$.data.iaqi.no2.v")} AS no2,
    {_number("$.data.iaqi.pm10.v")} AS pm10, {_number("$.data.iaqi.pm25.v")} AS pm25,
    {_number("$.data.iaqi.t.v")} AS temperature, {_number("$.data.time.v", "BIGINT")} AS "timestamp",
    {_number("$.data.city.geo[0]")} AS latitude, {_number("$.data.city.geo[1]")} AS longitude
  FROM laddered WHERE error IS NULL)"""
BAD_NAMES = """bad AS (
  SELECT DISTINCT city AS name FROM laddered WHERE error = 'unknown station'
  UNION SELECT s_name FROM supplier)"""

_WHOLES = ["aqi", "timestamp"]
_DOUBLES = ["co", "no2", "pm10", "pm25", "temperature", "latitude", "longitude"]
RECORDS = f"""rec AS (
  SELECT seq, city AS key, {_one_of(VALUES, c="city", a="aqi", e='"timestamp"')} AS value FROM m),
parsed AS (
  SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM rec),
checked AS (
  SELECT *, coalesce(json_type(j) = 'OBJECT' AND json_type(j, '$.city') = 'VARCHAR'
    AND {" AND ".join(f"json_type(j, '$.{c}') IN {_NUMBER}" for c in _WHOLES)}
    AND {" AND ".join(f"json_type(j, '$.{c}') IN {_NUMBER[:-1]}, 'NULL')" for c in _DOUBLES)},
    false) AS ok
  FROM parsed)"""


def _slice_of(seq: str, slices: int = SLICES) -> str:
    low, span = "(SELECT min(event_id) FROM events)", "(SELECT max(event_id) - min(event_id) + 1 FROM events)"
    return f"CAST(floor(({seq} - {low}) * {slices} / {span}) AS BIGINT)"


# A response counts if its city is valid and no response of an earlier slice
# had found the city's station unknown.
POLLED = f"""numbered AS (SELECT *, {_slice_of("seq")} AS slice FROM laddered),
live AS (SELECT n.* FROM numbered n JOIN r ON r.name = n.city WHERE r.valid_entry),
gone AS (SELECT city, min(slice) AS slice FROM live WHERE error = 'unknown station' GROUP BY city),
polled AS (
  SELECT l.* FROM live l LEFT JOIN gone g ON g.city = l.city
  WHERE g.city IS NULL OR l.slice <= g.slice)"""

FLAGS = """changes AS (
  SELECT CAST(user_id AS VARCHAR) AS name, event_type = 'purchase' AS valid_entry,
         epoch_us(ts) // 1000000 // 60 * 60 AS flag_at
  FROM events WHERE event_type IN ('error', 'purchase')),
newest AS (
  SELECT * FROM changes
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY flag_at DESC, valid_entry) = 1),
dated AS (
  SELECT *, CASE WHEN id % 40 < 35 THEN 1704067200 + id % 40 * 86400 END AS flag_at FROM r),
flagged AS (
  SELECT d.id, d.name, n.flag_at IS NOT NULL AND (d.flag_at IS NULL OR d.flag_at < n.flag_at
           OR (d.flag_at = n.flag_at AND NOT n.valid_entry)) AS taken,
         n.valid_entry AS new_flag, n.flag_at AS new_at, d.valid_entry, d.flag_at
  FROM dated d LEFT JOIN newest n ON n.name = d.name)"""
_FLAG_ROW = """SELECT name, CASE WHEN taken THEN new_flag ELSE valid_entry END AS valid_entry,
  CAST(CASE WHEN taken THEN new_at ELSE flag_at END AS BIGINT) AS flag_at FROM flagged"""
VERSIONED = f"""numbered AS (SELECT *, {_slice_of("seq", 3)} AS slice FROM laddered),
live AS (SELECT n.* FROM numbered n JOIN r ON r.name = n.city WHERE r.valid_entry),
gone AS (
  SELECT city, min(slice) AS slice FROM live
  WHERE error = 'unknown station' AND slice < {ENABLED_BEFORE} GROUP BY city),
polled AS (
  SELECT l.* FROM live l LEFT JOIN gone g ON g.city = l.city
  WHERE g.city IS NULL OR l.slice <= g.slice
    OR (l.slice >= {ENABLED_BEFORE} AND CAST(l.city AS BIGINT) % 2 = 0)),
found AS (SELECT DISTINCT slice, city FROM polled WHERE error = 'unknown station'),
counted AS (
  SELECT batch_id, (SELECT count(*) FROM r WHERE valid_entry)
      - (SELECT count(*) FROM gone WHERE slice < batch_id
           AND (batch_id < {ENABLED_BEFORE} OR CAST(city AS BIGINT) % 2 = 1)) AS new_count,
    (SELECT count(*) FROM found WHERE slice = batch_id) AS rows_affected
  FROM range(3) AS batches(batch_id)),
changed AS (SELECT *, coalesce(lag(new_count) OVER (ORDER BY batch_id), 0) AS old_count FROM counted)"""


def _with(*parts_and_query: str) -> str:
    *parts, query = parts_and_query
    return "WITH " + ",\n".join(parts) + "\n" + query


_HIST_COLUMNS = _list(HISTORY)
_RELOAD_LABEL = """CASE WHEN old_count = 0 AND new_count > 0
         THEN 'Cities loaded: 0 → ' || new_count || ' (scheduler now active!)'
       WHEN new_count <> old_count
         THEN 'Cities reloaded: ' || old_count || ' → ' || new_count || ' (change: '
              || CASE WHEN new_count > old_count THEN '+' ELSE '' END || (new_count - old_count) || ')'
       ELSE 'Cities reloaded: ' || new_count || ' (no changes)' END"""
_STATUS_ROW = f'SELECT city, "currentAqi", ema, {_list(STATUS)} FROM st'

ORACLE: dict[str, str] = {
    "rolling_ema": _with(M, _scored(), EMA),
    "rolling_ema_hot_keys": _with(M, _scored(), EMA),
    "rolling_ema_wide": _with(M, _scored(40), EMA),
    "alerts": _with(M, _scored(), _outcomes(), ALERTS),
    "outcomes": _with(M, _scored(), _outcomes(), OUTCOMES),
    "alerts_other_limits": _with(M, _scored(3), _outcomes(80, 2.0), ALERTS),
    "city_status": _with(M, _scored(), LATEST, _STATUS_ROW),
    "status_of_scored": _with(M, _scored(), LATEST, _STATUS_ROW),
    "status_one": _with(M, _scored(), LATEST, f"{_STATUS_ROW} WHERE city = '{CITY}'"),
    "status_unknown_city": _with(
        M, _scored(), LATEST, f"{_STATUS_ROW} WHERE city = 'no such city'"
    ),
    "latest_reading": _with(
        M,
        f"SELECT city, seq, {_list(READING[1:])} FROM m"
        " QUALIFY row_number() OVER (PARTITION BY city ORDER BY seq DESC) = 1",
    ),
    "known_cities": _with(M, "SELECT DISTINCT city FROM m"),
    "unknown_cities": _with(
        M, REG, "SELECT DISTINCT name AS city FROM r WHERE name NOT IN (SELECT city FROM m)"
    ),
    "status_replies": _with(
        M,
        _scored(),
        LATEST,
        REG,
        f"""SELECT r.name AS city, st.city IS NOT NULL AS found, "currentAqi", ema, {_list(STATUS)},
  CASE WHEN st.city IS NULL THEN 'City ''' || r.name || ''' not found or no data yet' END AS error
FROM r LEFT JOIN st ON st.city = r.name""",
    ),
    "history_keep_first": _with(
        M, DAILY, FIRST, 'SELECT seq, city, aqi, pm25, "timestamp" FROM f'
    ),
    "history_append": _with(
        M,
        DAILY,
        FIRST,
        TAKEN,
        f"SELECT {_HIST_COLUMNS} FROM f ANTI JOIN taken USING (city, \"timestamp\")",
    ),
    "history_duplicates": _with(
        M,
        DAILY,
        TAKEN,
        """n AS (SELECT *, row_number() OVER (PARTITION BY city, "timestamp" ORDER BY seq) AS rn FROM d)""",
        """SELECT seq, city, "timestamp" FROM n
WHERE rn > 1 OR EXISTS (SELECT 1 FROM taken t WHERE t.city = n.city AND t."timestamp" = n."timestamp")""",
    ),
    "history_insert_rejects": _with(
        M,
        """l AS (SELECT seq, city || repeat('x', aqi) AS city, aqi FROM m)""",
        """SELECT seq, city, aqi, 'city exceeds 64 characters' AS error FROM l WHERE length(city) > 64""",
    ),
    "history_rows": _with(
        M,
        f"""SELECT {_HIST_COLUMNS},
  strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%Y-%m-%d') AS day,
  "timestamp" * 1000 AS millis FROM m""",
    ),
    "history_topk": _with(
        M,
        HIST,
        f"""SELECT {_HIST_COLUMNS},
  CAST(row_number() OVER (PARTITION BY city ORDER BY "timestamp" DESC) AS INTEGER) AS rank
FROM h QUALIFY rank <= 24""",
    ),
    "history_one": _with(
        M,
        HIST,
        f"""SELECT {_HIST_COLUMNS} FROM h WHERE city = '{CITY}' ORDER BY "timestamp" DESC LIMIT 24""",
    ),
    "history_one_clamped": _with(
        M,
        HIST,
        f"""SELECT {_HIST_COLUMNS} FROM h WHERE city = '{CITY}' ORDER BY "timestamp" DESC LIMIT 1""",
    ),
    "history_replies": _with(
        M, HIST, f'SELECT {_list(HISTORY[:-1])}, "timestamp" * 1000 AS "timestamp" FROM h'
    ),
    "time_conversions": _with(
        M,
        """SELECT seq, "timestamp" * 1000 AS millis, "timestamp" AS seconds,
  strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM m""",
    ),
    "response_ladder": _with(
        M,
        RESP,
        LADDER,
        """SELECT seq, city, error, coalesce(error = 'unknown station', false) AS invalidates
FROM laddered""",
    ),
    "response_events": _with(M, RESP, LADDER, EVENTS, f"SELECT seq, {_list(READING)} FROM ev"),
    "response_rejects": _with(
        M,
        RESP,
        LADDER,
        "SELECT seq, city, status_code, body, error FROM laddered WHERE error IS NOT NULL",
    ),
    "response_invalid_cities": _with(
        M,
        RESP,
        LADDER,
        "SELECT DISTINCT city AS name FROM laddered WHERE error = 'unknown station'",
    ),
    "registry_valid": _with(REG, "SELECT * FROM r WHERE valid_entry ORDER BY name"),
    "registry_semi_join": _with(
        M,
        REG,
        "SELECT seq, city, aqi FROM m WHERE city IN (SELECT name FROM r WHERE valid_entry)",
    ),
    "registry_invalidate": _with(
        M,
        RESP,
        LADDER,
        REG,
        BAD_NAMES,
        """SELECT * REPLACE (CASE WHEN name IN (SELECT name FROM bad) THEN false ELSE valid_entry END
  AS valid_entry) FROM r""",
    ),
    "registry_invalidation_report": _with(
        M,
        RESP,
        LADDER,
        REG,
        BAD_NAMES,
        """SELECT bad.name, CASE WHEN r.name IS NULL THEN 0 ELSE 1 END AS rows_affected,
  CASE WHEN r.name IS NULL THEN 'city not found in database' END AS error
FROM bad LEFT JOIN r ON r.name = bad.name""",
    ),
    "registry_seed_insert": _with(
        REG,
        """seed AS (
  SELECT s_suppkey AS position, lower(n_name) AS name, s_name AS country, 'new' AS continent
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_custkey, CAST(c_custkey AS VARCHAR), 'taken', 'taken' FROM customer),
firsts AS (
  SELECT * FROM seed QUALIFY row_number() OVER (PARTITION BY name ORDER BY position) = 1)""",
        """SELECT id, name, country, continent, valid_entry FROM r
UNION ALL
SELECT CAST(NULL AS INTEGER), name, country, continent, true FROM firsts
WHERE name NOT IN (SELECT name FROM r)""",
    ),
    "registry_reload": _with(
        M,
        RESP,
        LADDER,
        REG,
        BAD_NAMES,
        """c AS (SELECT count(*) FILTER (valid_entry) AS old_count,
    count(*) FILTER (valid_entry AND name NOT IN (SELECT name FROM bad)) AS new_count FROM r)""",
        f"SELECT old_count, new_count, new_count - old_count AS change, {_RELOAD_LABEL} AS label FROM c",
    ),
    "topic_round_trip": _with(M, f"SELECT seq, {_list(READING)} FROM m"),
    "topic_decode": _with(
        M,
        RECORDS,
        f"""SELECT seq, json_extract_string(j, '$.city') AS city,
  CAST(trunc(CAST(json_extract_string(j, '$.aqi') AS DOUBLE)) AS INTEGER) AS aqi,
  {", ".join(f"CAST(json_extract_string(j, '$.{c}') AS DOUBLE) AS {c}" for c in _DOUBLES)},
  CAST(json_extract_string(j, '$.timestamp') AS BIGINT) AS "timestamp"
FROM checked WHERE ok""",
    ),
    "topic_rejects": _with(M, RECORDS, "SELECT seq, key, value FROM checked WHERE NOT ok"),
    "stream_outcomes": _with(M, _scored(), _outcomes(), OUTCOMES),
    "stream_history": _with(M, DAILY, FIRST, f"SELECT {_HIST_COLUMNS} FROM f"),
    "stream_status": _with(M, _scored(), LATEST, _STATUS_ROW),
    "stream_rejects": _with(M, RECORDS, "SELECT seq, key, value FROM checked WHERE NOT ok"),
    "stream_poll_events": _with(
        M,
        RESP,
        LADDER,
        REG,
        POLLED,
        EVENTS.replace("FROM laddered", "FROM polled"),
        f"SELECT seq, {_list(READING)} FROM ev",
    ),
    "stream_poll_invalid": _with(
        M,
        RESP,
        LADDER,
        REG,
        POLLED,
        """SELECT DISTINCT city AS name, 1 AS rows_affected, CAST(NULL AS VARCHAR) AS error
FROM polled WHERE error = 'unknown station'""",
    ),
    "registry_newest_flags": _with(REG, FLAGS, _FLAG_ROW),
    "registry_merge": _with(REG, FLAGS, f"{_FLAG_ROW} WHERE id % 2 = 0"),
    "stream_registry_events": _with(
        M,
        RESP,
        LADDER,
        REG,
        VERSIONED,
        EVENTS.replace("FROM laddered", "FROM polled"),
        f"SELECT seq, {_list(READING)} FROM ev",
    ),
    "stream_registry_reloads": _with(
        M,
        RESP,
        LADDER,
        REG,
        VERSIONED,
        f"""SELECT batch_id, old_count, new_count, new_count - old_count AS change, {_RELOAD_LABEL} AS label,
  rows_affected FROM changed""",
    ),
}
ORACLE["registry_seed_files"] = ORACLE["registry_seed_insert"].replace(
    "UNION ALL SELECT c_custkey, CAST(c_custkey AS VARCHAR), 'taken', 'taken' FROM customer", ""
)
ORACLE["city_status_wide"] = _with(M, _scored(1500), LATEST, _STATUS_ROW)
ORACLE["stream_history_one"] = _with(
    M, DAILY, FIRST, f"""SELECT {_HIST_COLUMNS} FROM f WHERE city = '{CITY}' ORDER BY "timestamp" DESC LIMIT 24"""
)
ORACLE["stream_status_one"] = ORACLE["status_one"]
ORACLE["stream_repeated_outcomes"] = ORACLE["stream_outcomes"]
ORACLE["registry_semi_join_salted"] = ORACLE["registry_semi_join"]

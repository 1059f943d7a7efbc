"""Runs queries and their SQL, where there is some, side by side and compares rows and types.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

SPARK_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    ours = {n: SPARK_TYPES.get(t, t) for n, t in df.dtypes}
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if ours != theirs:
        return f"schema {sorted(ours.items())} <> {sorted(theirs.items())}"
    names = list(df.columns)
    got = _rows([tuple(r) for r in df.collect()], names)
    want = _rows(con.execute(sql).fetchall(), list(theirs))
    if len(got) != len(want):
        return f"{len(got)} rows <> {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} <> {w}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from breezeline.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or sqls:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, queries[name], sqls[name])
        except Exception as e:  # report and go on to the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{name}: {problem or 'ok'} ({time.time() - start:.2f}s)", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

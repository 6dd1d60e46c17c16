"""Compare registered queries with their SQL on the supplied tables.

Run as ``python -m tests.oracle [name ...]``; ORACLE_SF selects the scale.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

from wardframe.plans.inputs import SOURCES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in SOURCES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value, digits: int):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return None
        return round(float(value), digits) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _rows(columns, rows, digits):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(spark, con, run, sql: str, sf_dir: str, digits: int = 6) -> str:
    """Empty text when both sides agree, else the first difference."""
    start = time.time()
    df = run(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()], digits)
    took = time.time() - start
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall(), digits)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({took:.1f}s), e.g. {bad[0]}"
    compare.last = (len(got), took, time.time() - start - took)
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from wardframe.session import get_session

    sf_dir = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
    spark = get_session(
        "oracle", master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    failed = 0
    for name in names:
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], sf_dir)
                detail = "" if problem else "rows={} spark={:.1f}s duckdb={:.1f}s".format(*compare.last)
            else:
                start = time.time()
                problem, detail = "", f"rows={len(queries[name](spark, sf_dir).collect())} (no SQL) {time.time() - start:.1f}s"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(("FAIL " if problem else "ok   ") + name + " " + (problem or detail), flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")


if __name__ == "__main__":
    main()

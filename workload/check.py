"""Compare registered queries with their SQL: ``python -m workload.check [sf_dir] [names...]``."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

from workload.base import REGISTRY, TABLES, Inputs, oracle_text


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v.normalize()))
    if isinstance(v, float):
        return ("float", v)
    if isinstance(v, datetime.datetime):
        return ("ts", v.isoformat())
    return (type(v).__name__, v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def compare(spark, duck, sf_dir, name):
    """(status, n_rows, seconds, detail)"""
    entry = REGISTRY[name]
    started = time.time()
    df = entry.run(Inputs(spark, sf_dir))
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    sql = oracle_text(entry)
    if sql is None:
        return "rows-only", len(got), seconds, ""
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), seconds, f"{sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return "ok", len(got), seconds, ""
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return "DIFF", len(got), seconds, f"{len(a)} vs {len(b)} rows\n   spark {only_a}\n   sql   {only_b}"


def oracle_engine(sf_dir):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return duck


def main(argv):
    import workload.all  # noqa: F401
    from fieldloom.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(REGISTRY)
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = oracle_engine(sf_dir)
    bad = 0
    for name in [n for n in REGISTRY if any(n == x or n.startswith(x) for x in names)]:
        try:
            status, n, seconds, detail = compare(spark, duck, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - report and go on
            status, n, seconds, detail = "ERROR", 0, 0.0, str(e)[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:34} {n:8} {seconds:6.2f}s {detail}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

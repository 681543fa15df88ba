"""Compare registered queries with their oracle SQL: ``python tools/check.py [sf] [name-part ...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

from commitloom.plans.bindings import SOURCES  # noqa: E402
from commitloom.plans.registry import load_all, runner  # noqa: E402
from commitloom.session import build_session  # noqa: E402


def canon(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 5) + 0.0
    if isinstance(value, int):
        return round(float(value), 5)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, datetime.date):
        return f"{value.isoformat()} 00:00:00"
    if isinstance(value, (list, tuple)):
        return [canon(v) for v in value]
    if isinstance(value, dict):
        return {k: canon(v) for k, v in value.items()}
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canon(row[i]) for i in order]) for row in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                               "spark.driver.memory": "12g",
                               "spark.sql.execution.arrow.pyspark.enabled": "true"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, query in load_all().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        began = time.time()
        try:
            frame = runner(query)(spark, folder)
            got = [tuple(r) for r in frame.collect()]
            spent = time.time() - began
            if query.oracle is None:
                print(f"rows {name}: {len(got)} rows, {spent:.1f}s", flush=True)
                continue
            con = duckdb.connect()
            for table in SOURCES:
                con.sql(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
            began = time.time()
            result = con.sql(query.oracle)
            want, columns = result.fetchall(), result.columns
            oracle_spent = time.time() - began
            if sorted(columns) != sorted(frame.columns):
                bad += 1
                print(f"FAIL {name}: columns {sorted(frame.columns)} != {sorted(columns)}", flush=True)
                continue
            a, b = rows_of(frame.columns, got), rows_of(columns, want)
            if a != b:
                bad += 1
                print(f"FAIL {name}: {len(a)} rows, oracle {len(b)}; columns {sorted(columns)}")
                sa, sb = set(a), set(b)
                print("   spark :", [x for x in a if x not in sb][:2])
                print("   oracle:", [x for x in b if x not in sa][:2], flush=True)
            else:
                note = "" if a else "  EMPTY"
                print(f"ok   {name}: {len(a)} rows, {spent:.1f}s, oracle {oracle_spent:.1f}s{note}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

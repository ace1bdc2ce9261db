"""Run registered queries beside their SQL and compare rows.  ``python tests/check_oracle.py [-d DIR] [name ...]``"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entrypoint  # noqa: E402
from sigvane.runtime import local_session  # noqa: E402


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, (int,)):
        return f"n{float(value)!r}"
    if isinstance(value, float):
        return f"n{value + 0.0!r}" if value != 0 else "n0.0"
    return str(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in records)


FAMILIES = {
    "int": {"TINYINT", "SMALLINT", "INTEGER", "BIGINT", "int", "bigint", "smallint"},
    "double": {"DOUBLE", "double"},
    "text": {"VARCHAR", "string"},
}


def family(kind):
    return next((f for f, kinds in FAMILIES.items() if str(kind) in kinds), str(kind))


def compare(spark, con, name, run, sql, directory):
    start = time.time()
    df = run(spark, directory)
    spark_rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return "rows-only", seconds, len(spark_rows), ""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", seconds, len(spark_rows), f"{sorted(set(columns) ^ set(df.columns))}"
    expected_types = {d[0]: family(d[1]) for d in cursor.description}
    wrong = {c: (t, expected_types[c]) for c, t in df.dtypes if family(t) != expected_types[c]}
    if wrong and not all(v is None for r in expected for v in [r[columns.index(c)] for c in wrong]):
        return "TYPES", seconds, len(spark_rows), str(wrong)
    left, right = rows_of(df.columns, [tuple(r) for r in spark_rows]), rows_of(columns, expected)
    if left == right:
        return "ok", seconds, len(left), ""
    only_left = [r for r in left if r not in set(right)][:2]
    only_right = [r for r in right if r not in set(left)][:2]
    return "DIFF", seconds, len(left), f"{len(left)} vs {len(right)} {sorted(columns)}\n  spark {only_left}\n  sql   {only_right}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", "--directory", default="/root/testdata/sf0.01")
    parser.add_argument("--plans", help="file to write the executed plans to")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{args.directory}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    queries, oracles = entrypoint.queries(), entrypoint.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            if args.plans:
                df = run(spark, args.directory)
                df.collect()
                with open(args.plans, "a") as out:
                    out.write(f"=== {name}\n{df._jdf.queryExecution().executedPlan().toString()}\n")
                continue
            status, seconds, rows, note = compare(spark, con, name, run, oracles.get(name), args.directory)
        except Exception as error:  # noqa: BLE001
            status, seconds, rows, note = "ERROR", 0.0, -1, f"{type(error).__name__}: {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if status in ("ok", "rows-only") and rows == 0:
            status += " EMPTY"
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {seconds:6.2f}s {rows:7d} {name} {note}", flush=True)
    print(f"bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Run registered queries next to their SQL twins and compare whole results.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return int(value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_cols, spark_rows, duck_cols, duck_rows) -> str:
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {sorted(spark_cols)} / {sorted(duck_cols)}"
    a, b = rows_of(spark_cols, spark_rows), rows_of(duck_cols, duck_rows)
    if len(a) != len(b):
        return f"row counts differ: {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"rows differ:\n  spark {str(x)[:600]}\n  duck  {str(y)[:600]}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from skein.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", 8, **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        try:
            start = time.time()
            df = queries[name](spark, args.sf)
            rows = df.collect()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name}: {len(rows)} rows, spark {took:.1f}s", flush=True)
                continue
            start = time.time()
            result = con.execute(oracles[name])
            cols = [d[0] for d in result.description]
            duck_rows = result.fetchall()
            problem = compare(df.columns, rows, cols, duck_rows)
            print(f"{'FAIL' if problem else 'ok'}  {name}: {len(rows)} rows, spark {took:.1f}s, duck {time.time() - start:.1f}s {problem}",
                  flush=True)
            bad += bool(problem)
        except Exception as exc:  # keep going: one report per query
            print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
            bad += 1
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

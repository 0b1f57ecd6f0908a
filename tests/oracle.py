"""Runs registered queries next to their SQL twins and compares whole results.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, "bool", v)
    if isinstance(v, int):
        return (2, float(v), "int")
    if isinstance(v, float):
        return (2, 0.0 if v == 0 else v, "float")
    return (3, str(v))


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, name, plan, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    cols, got = rows_of_spark(plan(spark, sf_dir))
    want_cols, want = rows_of_duck(con, sql)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "both empty"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        g, w = diff[0]
        cell = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b][:3]
        return f"{len(diff)}/{len(got)} rows differ, first: {cell}"
    return None


def main() -> int:
    from stopflow.plans.registry import oracle_sql, queries
    from stopflow.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        args = args[:i] + args[i + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    plans, sqls = queries(), oracle_sql()
    bad = 0
    for name, plan in plans.items():
        if args and not any(name == a or name.startswith(a + "_") or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        started = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, plan, sqls[name], sf_dir)
            else:
                cols, got = rows_of_spark(plan(spark, sf_dir))
                problem = None if got else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - started
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.2f}s{'' if name in sqls else ' (rows only)'}"
              + (f"  {problem}" if problem else ""), flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

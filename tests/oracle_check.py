"""Runs catalog queries next to their SQL and compares every value.

    python tests/oracle_check.py [sf] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[:-8]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def shown(value):
    import pandas as pd

    if pd.isna(value):
        return "<null>"
    return f"{value:.9f}" if isinstance(value, float) else str(value)


def rows_of(frame, columns):
    values = [[shown(v) for v in frame[c].astype(object)] for c in columns]
    return sorted(zip(*values))


def width(dtype) -> str:
    return str(dtype).lower().replace("str", "object").replace("string", "object")


def compare(spark, db, name: str, sf_dir: str, sql: str) -> str:
    """Empty when equal, else what differs."""
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = db.execute(sql).df()
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    mine, theirs = rows_of(got, columns), rows_of(want, columns)
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if different:
        return f"{len(different)} rows differ, first {different[0]}"
    kinds = [(c, got[c].dtype, want[c].dtype) for c in columns
             if width(got[c].dtype) != width(want[c].dtype)]
    return f"types {kinds}" if kinds and len(got) else ""


def main() -> int:
    import faulthandler
    faulthandler.enable()
    from flowwatch.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls = connect(sf_dir), entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                result = compare(spark, db, name, sf_dir, sqls[name])
            else:
                rows = entry.queries()[name](spark, sf_dir).collect()
                result = "" if rows else "no rows"
                print(rows[:6])
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(result)
        print(f"{'FAIL' if result else 'ok  '} {name} {time.time() - start:.1f}s {result}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() and 1)

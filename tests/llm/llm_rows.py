"""Shared by the tests: rows, and a query next to its SQL in DuckDB."""

import os
import sys

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(str(r[k]) if not isinstance(r[k], float) else f"{r[k]:.9g}" for k in sorted(r.keys())) for r in rows))


def spark_rows(df):
    return plain([r.asDict() for r in df.collect()])


def sql_rows(sql, sf=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return plain([dict(zip(names, r, strict=True)) for r in found.fetchall()])


def same_as_sql(spark, name, sf=SMALL):
    from flowwatch.llm.queries import ORACLES, QUERIES

    got, want = spark_rows(QUERIES[name](spark, sf)), sql_rows(ORACLES[name], sf)
    assert len(got) == len(want)
    assert got == want


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from flowwatch.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    for query in sys.argv[2:]:
        same_as_sql(session, query, sys.argv[1])
        print(query, "equal")

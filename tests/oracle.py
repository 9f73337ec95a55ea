"""Compare a query with its SQL on the driver's smallest tables."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(r) for r in frame.where(frame.notna(), None).itertuples(index=False)), key=repr)


def assert_equal(df, con, sql):
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

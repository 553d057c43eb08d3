"""Spark results against the same SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _key(row):
    return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in row)


def same(df, sql, sf_dir):
    c = connect(sf_dir)
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(_key(r[names.index(n)] for n in order) for r in want.fetchall())
    got = sorted(_key(r[n] for n in order) for r in df.collect())
    assert got == expected

"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from vicinal.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return str([plain(v) for v in x])
    if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "none"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return repr(float(x) + 0.0)
    return str(int(x)) if isinstance(x, (int, np.integer)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    got = {r.kind: (r.edges, r.homophily) for r in entry.entry(spark).collect()}
    assert got == {"train->test": (2160, 0.088889), "train->train": (5874, 0.108614), "train->val": (2580, 0.087984)}
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import pytest

from sillar.plans import oracle, queries


def _rows(frame):
    import numpy as np
    import pandas as pd

    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = pd.to_datetime(frame[c], utc=True).dt.strftime("%F %T.%f")
    one = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else f"{v:.6g}" if isinstance(v, (float, np.floating)) else str(v)
    return sorted((tuple(map(one, r)) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    got = queries.queries()[name](spark, data)
    want = duck.sql(oracle.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.toPandas()) == _rows(want.df())


def test_rows_only(spark, data):
    q = queries.queries()
    for name in set(q) - set(oracle.oracle_sql()):
        assert q[name](spark, data).count() > 0, name


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["question_id", "chunk_id", "file_path", "distance"]

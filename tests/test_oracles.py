"""Every library query against its SQL on DuckDB, as the driver compares them."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from taperflow import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        s = df[c]
        if s.dtype == object or str(s.dtype).startswith("datetime") or str(s.dtype) == "str":
            out[c] = s.map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "year") else str(v))
        else:
            out[c] = s.astype(float).round(5)
    return pd.DataFrame(out).sort_values(sorted(out), ignore_index=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, con, name):
    a, b = plain(plans.QUERIES[name](spark, SF).toPandas()), plain(con.execute(plans.ORACLES[name]).df())
    assert list(a) == list(b) and len(a) == len(b) > 0
    for c in a:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c].astype(float), rtol=1e-9, atol=2e-5, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c

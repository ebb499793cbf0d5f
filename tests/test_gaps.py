"""Queries against their SQL on series that lack months."""

import shutil

import duckdb
import numpy as np
import pytest
from test_oracles import SF, TABLES, plain

from taperflow import plans


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """The tables of sf0.001 without the line items of months 5, 72 and 74, for two thirds of the suppliers."""
    d = tmp_path_factory.mktemp("gaps")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if t != "lineitem":
            shutil.copy(f"{SF}/{t}.parquet", f"{d}/{t}.parquet")
    month = "(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1"
    con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/lineitem.parquet') WHERE {month} NOT IN (5, 72, 74) OR l_suppkey % 3 = 0) TO '{d}/lineitem.parquet' (FORMAT parquet)")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con, str(d)


@pytest.mark.parametrize("name", ["jn_03_precomputed_missing", "met_09_missing_forecasts", "src_05_precomputed"])
def test_gaps(spark, gaps, name):
    con, d = gaps
    a, b = plain(plans.QUERIES[name](spark, d).toPandas()), plain(con.execute(plans.ORACLES[name]).df())
    assert list(a) == list(b) and len(a) == len(b) > 0
    for c in a:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c].astype(float), rtol=1e-9, atol=2e-5, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c

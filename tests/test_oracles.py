"""Raster queries against their SQL on the smallest tables."""

import duckdb
import pytest

from rasterweave.plans import catalog

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert (a[c] == b[c]).all(), c

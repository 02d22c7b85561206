"""Every query of the catalog runs, and equals its oracle, on the smallest tables."""

import glob
import os

import pytest

from rasterweave.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "null" if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(map(str, map(cell, row))) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = oracle.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)

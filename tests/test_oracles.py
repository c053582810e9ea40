"""Every registered query with SQL gives what DuckDB gives, on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

from scenarium.plans import candidate_catalog, catalog, extended_catalog, grouped_catalog, placement_catalog, planar_catalog, pose_catalog, region_catalog, scene_catalog, spatial_catalog, tree_catalog  # noqa: F401  the others register their queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return con


def plain(v):
    return (round(v, 5) + 0.0 if math.isfinite(v) else str(v)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).columns

"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from pixelframe.plans import catalog, catalog_more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"cl_kmeans", "md_forest", "md_approx_gp", "md_cubist", "md_krige", "md_svr", "md_krige_universal", "md_mlkrige", "ras_deconvolve", "st_super_learner", "hp_tpe", "sh_forest", "cv_classes"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [q for q in catalog.QUERIES if q in catalog.ORACLE_SQL])
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [list(want.columns).index(c) for c in df.columns]
    a = sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)
    b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(SLOW))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0

"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "iuf" or "Int" in str(frame[c].dtype):
            frame[c] = frame[c].astype("float64").round(4)
        else:
            frame[c] = frame[c].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = rows(catalogue.QUERIES[name](spark, SF).toPandas())
    want = rows(duck.execute(catalogue.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_component_fold_shares_add_up(spark):
    got = catalogue.QUERIES["component_fold"](spark, SF).toPandas()
    assert len(got) and (got.groupby("component").share.sum() - 1).abs().max() < 1e-4

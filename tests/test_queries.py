"""Every query that has SQL gives the same rows as DuckDB does."""

import glob
import importlib.util
import math
import os

import duckdb
import numpy as np
import pytest
from memlake import plans


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return float(f"{v:.9g}") + 0.0
    return v.item() if isinstance(v, np.generic) else v if isinstance(v, (int, bool)) else str(v)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES) - {"bpe_train", "hybrid_retrieve"}))
def test_queries_without_sql_run(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry_module_lists_them_all(spark):
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

"""Every query with SQL against DuckDB, value by value; the others must give rows."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from varve.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, con, name):
    a, b = catalogue.queries()[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    a, b = (f[columns].sort_values(columns, kind="stable").reset_index(drop=True) for f in (a, b))
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=2e-5, equal_nan=True), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", ["effective_dof_p", "screening_table", "lowpass_state", "resolution_fusion", "lowfreq_adjustment", "spectral_skill"])
def test_other_queries_give_rows(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_model_inputs_are_averaged_once(spark):
    """The plans read their inputs many times; none of these may lead back to the sales."""
    from varve.plans import modelling

    obs, records, selected, target = modelling._inputs(spark, SMALL)
    for df in (obs, records, selected, target):
        assert not [f for f in df.inputFiles() if "lineitem" in f or "part.parquet" in f]
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

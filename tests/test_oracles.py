"""Every registered query runs; those with SQL give the same rows."""

import pytest
from compare import compare
from conftest import SF

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(duck, df, ORACLES[name]).startswith("ok")
    else:
        assert df.columns and df.count() >= 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and {"cam_idx", "n_points", "mean_depth"} == set(rows[0].asDict())

"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, sf, name):
    got = contract.queries()[name](spark, sf).toPandas()
    checks = contract.oracle_sql()
    if name in checks:
        assert compare(got, con.sql(checks[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"reason_closed", "n_phases", "mean_duration", "mean_events"}

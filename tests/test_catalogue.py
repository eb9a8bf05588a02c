"""Each registered query of the reference's operators against its SQL on the smallest tables."""

import pytest

from kgweave.plans import catalogue
from tests.oracle import connect, same

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_rows(spark, con, name):
    same(catalogue.QUERIES[name](spark, DIR).toPandas(), con.execute(catalogue.SQL[name]).fetch_df())


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

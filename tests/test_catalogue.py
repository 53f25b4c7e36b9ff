import pytest

import __spark_entry__ as entry
from rockframe.plans.catalogue import ORACLE, QUERIES
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"q87_intrusion"}))
def test_without_sql_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

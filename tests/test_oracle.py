"""Every query with a SQL twin gives the same rows as another engine."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare_oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, other, name):
    ours = queries()[name](spark, FOLDER).toPandas()
    assert difference(ours, other.execute(oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "split" in df.columns


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())

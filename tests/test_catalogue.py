"""Every query over the small tables says what its SQL says."""

import pytest
from oracle import assert_same

from tidemark import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, small, name):
    assert name in catalogue.ORACLE
    assert_same(spark, small, catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0

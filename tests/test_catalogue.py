import pytest

from quarry.catalogue import oracle_sql, queries
from tests.conftest import SF
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, queries()[name], oracle_sql()[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query of the library gives what its SQL gives, or at least runs."""

import pytest
from compare import SF, duck, duck_rows, spark_rows

from lorespan import queries as Q


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, SF)
    sql = Q.oracle_sql().get(name)
    got = spark_rows(df)
    if sql is not None:
        assert got == duck_rows(con, sql)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

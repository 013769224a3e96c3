"""Every registered query against its SQL."""

import pytest

from tessera import queries

from .oracle import DATA, connect, rows


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    got = rows(queries.QUERIES[name](spark, DATA).toPandas())
    assert got == rows(con.execute(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

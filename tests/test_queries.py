"""Every core query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest

from corpusloom import plans

Q, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(name, spark, data, duck, same):
    df = Q[name](spark, data)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_sql_has_a_query_each():
    assert set(SQL) <= set(Q)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query of the core runs; those with SQL give what DuckDB gives."""

import pytest
from compare import assert_same

from gridloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        assert_same(df, duck.sql(ORACLE[name]))
    else:
        assert df.columns
        df.collect()


def test_entry(spark, data):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert {"feature", "level", "AUROC"} <= set(df.columns)
    assert df.count() == 12

"""Every query against its SQL."""

import pytest
from compare import same

from docquarry.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    same(catalogue.queries()[name](spark, sf_dir), duck.sql(SQL[name]))


def test_those_without_sql_have_rows(spark, sf_dir):
    for name in set(catalogue.queries()) - set(SQL):
        assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

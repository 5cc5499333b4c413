import pytest
from conftest import DATA, same_rows

from lumenweir.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    if name in catalog.oracle_sql():
        same_rows(df, duck.sql(catalog.oracle_sql()[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

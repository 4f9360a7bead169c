"""Every registered query with an oracle, against DuckDB on sf0.001 (fast); the driver runs
the same comparison at sf0.01."""

import pytest

import __spark_entry__ as E
from densitykit.plans import catalog
from tests.conftest import SF
from tests.harness import compare

NAMES = sorted(catalog.QUERIES)  # the corpus queries have their own tests


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck001, name):
    df = E.queries()[name](spark, SF["0.001"])
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    ok, msg = compare(df, duck001, sql)
    assert ok, msg


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "label", "kind"] and df.count() == 200

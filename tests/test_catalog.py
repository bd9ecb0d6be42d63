"""Every query of the catalog with SQL gives the rows of that SQL; the others give rows."""

import pytest
from conftest import DATA

from logsignals.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, DATA), catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

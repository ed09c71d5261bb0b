"""Every registered query with SQL must give the oracle's rows."""

import pytest
from compare import compare

from motionlake import catalog

ENTRIES = catalog.entries()


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_matches_sql(spark, sf_dir, name):
    entry = ENTRIES[name]
    assert compare(spark, sf_dir, entry.run, entry.sql) is None


def test_entry_file_exposes_all_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ENTRIES) <= set(entry.queries())

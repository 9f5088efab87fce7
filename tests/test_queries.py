"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import duck_rows, spark_rows

from millrace.plans import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    got_columns, got = spark_rows(QUERIES[name](spark, sf))
    want_columns, want = duck_rows(ORACLE[name], sf)
    assert got_columns == want_columns
    assert got == want


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLE) == {"chunk_split", "cycle_listing", "edges_within_cycles", "report_dependency_risk", "report_health"}


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

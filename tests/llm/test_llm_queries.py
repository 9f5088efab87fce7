"""The registered queries of the subpackage against their SQL."""

import pytest
from compare import duck_rows, spark_rows

from millrace.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(ORACLE[name], sf)

"""The registered queries of the subpackage that have SQL, on the smallest given tables."""

import os

import pytest

import compare
from siftwell.llm.oracle import SQL
from siftwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    columns, rows = compare.rows_of_spark(QUERIES[name](spark, SF))
    want_columns, want = compare.rows_of_sql(compare.connect(SF), SQL[name])
    assert columns == want_columns and rows == want and rows

"""Registered queries that SQL can express give the rows that DuckDB gives."""

import os

import compare
import pytest

from tidewatch.llm import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, name):
    frame = queries.queries()[name](spark, SF).toPandas()
    assert len(frame)
    assert not compare.differences(frame, oracle.oracle_sql()[name], compare.connection(SF))

"""The queries that SQL can express, against it on the smallest tables, and what the package registers."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import connect, difference
from tastemesh.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLE[name]).df()) is None


def test_registered():
    names = entry_points.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert ORACLE.items() <= entry_points.oracle_sql().items()

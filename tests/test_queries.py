"""Every query against its SQL in DuckDB, at the smallest scale."""

import os

import pytest
from oracle import DATA, duck, spark_rows

from corpusloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    sf = f"{DATA}/{os.environ.get('TEST_SF', 'sf0.001')}"
    got, want = spark_rows(registry.QUERIES[name](spark, sf)), duck(sf, registry.SQL[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, f"{DATA}/sf0.001").count() >= 0

"""Registered queries against their SQL on the smallest data."""

import os
import re

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from workload import adapters, oracles, registry

DIRECTORY = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()
QUERIES = registry.queries()
ROWS_ONLY = {"semantic_clusters"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], DIRECTORY) is None


def test_semantic_clusters_invariants(spark):
    rows = QUERIES["semantic_clusters"](spark, DIRECTORY).collect()
    ids = {r.cluster_id for r in rows}
    assert ids == set(range(len(ids))) and 2 <= len(ids) <= 9
    assert sum(r.is_cluster_representative for r in rows) == len(ids)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_market_is_reduced_before_it_moves(spark, tmp_path):
    """Pairs of supplier and nation are made of the lines at once, not of all pairs of supplier and buyer."""
    tables = {
        "lineitem": ([(1, 7), (1, 8), (2, 7), (3, 7), (9, 7)], "l_orderkey LONG, l_suppkey LONG"),
        "orders": ([(1, 10), (2, 11), (3, None), (4, 12)], "o_orderkey LONG, o_custkey LONG"),
        "customer": ([(10, "a", "m", 0), (11, "b", "m", 0), (12, "c", "m", 1)], "c_custkey LONG, c_name STRING, c_mktsegment STRING, c_nationkey INT"),
        "nation": ([(0, "X"), (1, "Y")], "n_nationkey INT, n_name STRING"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    market = adapters.market_raw(spark, str(tmp_path))
    assert "hashpartitioning(l_suppkey#" in (plan := market._jdf.queryExecution().executedPlan().toString())
    assert not re.search(r"hashpartitioning\(l_suppkey#\d+L?, c_custkey#", plan)
    assert sorted((r.author_id, r.record[0].id) for r in market.collect()) == [("n0", "c10"), ("n0", "c11"), ("n1", "c12"), ("s7", "n0"), ("s8", "n0")]

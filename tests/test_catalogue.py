"""Queries against their SQL on the smallest tables, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tessera.plans.catalogue import ORACLE_SQL, QUERIES
from tessera.session import TABLES

SF = "/root/testdata/sf0.001"
CHECKED = [
    "point_lookup", "tokenize_stats", "uuid5_ids", "bm25_topk", "symbol_expansion", "knn_topk", "rrf_fusion", "hybrid_search", "latency_percentiles", "trace_cost", "hash_diff",
    "call_graph_inversion", "bfs_expand", "bfs_capped", "ttl_cache_hits", "graph_constructor_edges", "explicit_symbols", "repo_profile", "exact_symbol_prefix", "neighbour_resolution", "chunk_python", "call_order", "rewrite_normalise", "structural_priority", "topic_terms",
]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(ORACLE_SQL[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == columns
    rows = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == rows


def test_contract(spark):
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0

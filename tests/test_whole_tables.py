"""A capped traversal against one step at a time: the cap is tested after each row that is added."""

from collections import defaultdict

import duckdb

from tessera.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_capped_traversal_adds_one_row_a_hop_at_least(spark):
    near = defaultdict(set)
    for s, p in duckdb.sql(f"SELECT DISTINCT l_suppkey, l_partkey FROM '{SF}/lineitem.parquet'").fetchall():
        near[f"s{s}"].add(f"p{p}")
        near[f"p{p}"].add(f"s{s}")
    want = set()
    for seed in [n for n in near if n[0] == "s"]:
        seen, frontier, taken = {seed: 0}, [seed], 0
        for hop in (1, 2, 3):
            added = []
            for new in (n for parent in frontier for n in sorted(near[parent])):
                if new in seen:
                    continue
                seen[new] = hop
                added.append(new)
                taken += 1
                if taken >= 15:
                    break
            frontier = added
        want |= {(seed, n, hop) for n, hop in seen.items()}
    got = QUERIES["bfs_capped"](spark, SF).collect()
    assert {(r.question, r.id, r.graph_distance) for r in got} == want and len(got) == len(want)

"""Recall of repeated passages on the rows that op1 returns."""

import random

from tessera.llm import paragraph_dedup


def test_short_passages_and_copies_have_rows(spark):
    rng, n = random.Random(11), 400
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    some = lambda k: [word() for _ in range(k)]
    rows = []
    for k in range(n):
        passage = some(51)
        rows += [(2 * k + j, " ".join(some(40) + passage + some(40))) for j in range(2)]
    for k in range(8, 20):
        rows += [(10_000 + 2 * k + j, text) for text in [" ".join(some(k))] for j in range(2)]
    alone = [(20_000 + k, " ".join(some(60))) for k in range(50)]
    got = paragraph_dedup.repeats(spark.createDataFrame(rows + alone, "doc_id long, text string")).collect()
    ids = {r.id for r in got}
    # A passage without two inner cuts has no paragraph of its own: 0.5 % at 51 words.
    assert sum({2 * k, 2 * k + 1} <= ids for k in range(n)) >= 0.98 * n
    assert {10_000 + 2 * k + j for k in range(8, 20) for j in range(2)} <= ids
    assert not ids & {k for k, _ in alone}

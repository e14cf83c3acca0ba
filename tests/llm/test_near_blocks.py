"""Groups give every link between alike texts, whichever way they are compared."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import linking, near_dedup


def drawn(n, seed, changed):
    """Pairs of texts of 180 shingles, of which the last ``changed`` differ."""
    rng = random.Random(seed)
    some = lambda k: [f"w{rng.randrange(1 << 40):x}" for _ in range(k)]
    for _ in range(n):
        a = some(184)
        yield " ".join(a), " ".join(a[: 184 - changed] + some(changed))


def test_pairs_just_alike_are_linked(spark):
    pairs = list(drawn(200, 1, 20)) + list(drawn(50, 2, 21))
    texts = [(k, t) for k, t in enumerate(t for p in pairs for t in p)]
    got = near_dedup.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    # (180 - 20) / (180 + 20) = 0.8 is linked, one shingle fewer isn't; 7 of 100,000 share no band.
    assert sum(r.class_id != r.id for r in got) == 200 and all(r.id - r.class_id == r.id % 2 for r in got if r.id < 400)


@pytest.mark.parametrize("group", [1 << 20, 900, 200])
def test_a_large_group_is_compared_exactly(spark, group):
    """One band of three clusters and many loners that share half of their items: whole, divided, and in blocks."""
    rng = random.Random(3)
    common = [rng.getrandbits(62) for _ in range(20)]
    own = lambda k: [rng.getrandbits(62) for _ in range(k)]
    sets = [common + own(20) for _ in range(40)]
    for _ in range(3):
        base = common + own(20)
        sets += [base] + [base[: 40 - k] + own(k) for k in (1, 2, 3, 4)] + [base[:20] + own(20)]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if alike(set(sets[i]), set(sets[j])):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {k: root(k) for k in range(len(sets)) if any(root(k) == root(j) for j in range(len(sets)) if j != k)}
    frame = spark.createDataFrame(list(enumerate(sets)), "key long, items array<long>")
    multi = frame.select(F.explode(F.array(F.lit(5).cast("long"), F.lit(6).cast("long"))).alias("band"), "key", F.size("items").alias("size"))
    for centre_from in (0, 1 << 30):
        _, labels = linking.linked(multi, frame, 0.8, centre_from=centre_from, group=group)
        assert {r.node: r.component for r in labels.collect()} == want

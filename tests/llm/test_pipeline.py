"""The stages: columns stay, rows only go, decisions are those of brute force, odd rows don't crash."""

import shutil
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm.common import staged, table
from test_edges import SCHEMA, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets, and the last one's result."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(staged(stage(spark, out[-1], SF)))
    return [*(d.collect() for d in out), corpus_pipeline.STAGES[-1][1](spark, out[-1], SF).collect()]


def test_stages_keep_the_columns(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert list(after[0].asDict()) == list(before[0].asDict()) and 0 < len(after) <= len(before)
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        assert all(r.n_chars == len(r.text) for r in after)
    assert {r.doc_id for r in stages[-1]} == {r.doc_id for r in stages[-2]}


def test_near_duplicates_and_repeats_as_by_brute_force(stages):
    shingles = lambda t: Counter(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) or Counter([tuple(t.lower().split())])
    before, kept = stages[1], {r.doc_id for r in stages[2]}
    held = {r.doc_id: (r.text, shingles(r.text)) for r in before}
    root = {k: k for k in held}
    for a in sorted(held):
        for b in sorted(held):
            x, y = held[a][1], held[b][1]
            if a < b and (held[a][0] == held[b][0] or sum((x & y).values()) >= 0.8 * sum((x | y).values())):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert kept == {k for k, v in root.items() if k == v}
    seen = Counter(r.text.encode()[i : i + 200] for r in stages[2] for i in range(len(r.text.encode()) - 199))
    want = {}
    for r in stages[2]:
        raw = r.text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        left = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left.strip() or not any(gone):
            want[r.doc_id] = left
    assert {r.doc_id: r.text for r in stages[3]} == want


def test_no_benchmark_passage_is_left(spark, stages):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(words(t)[i : i + n]) in windows for n in sizes for i in range(len(words(t)) - n + 1))
    left = {r.doc_id: r.text for r in stages[4]}
    for r in stages[3]:
        assert hit(r.text) if r.doc_id not in left else left[r.doc_id] == r.text or hit(r.text)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.createDataFrame(rows(), SCHEMA)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert {(r.key, r.id, r.band) for r in out.collect()} == {("clash", 9, 7)}, name
        assert stage(spark, none, str(tmp_path)).collect() == [], name
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).collect() == []

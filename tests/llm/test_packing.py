"""Packing: exact round trip against the tokenizer itself, and the shape of the sequences."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing

SCHEMA = "doc_id long, text string, start string, _row long"


def plain_ids(text):
    t = Tokenizer.from_file(packing.tokenizer_paths()[0])
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def packed(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    return packing.pack(docs, *packing.tokenizer_paths(), **options).collect()


def check(rows, pieces, length):
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2").tolist()
        assert len(ids) == p.length > 0
        whole[p._row.doc_id, p._row.text].append((p.start, ids, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for (_, text), parts in whole.items():
        want = plain_ids(text)
        copies = len(parts) and sum(s == 0 for s, *_ in parts)
        assert sorted(i for _, ids, _ in parts for i in ids) == sorted(want * copies)
        assert {n for *_, n in parts} == {len(want)}
        if copies == 1:
            assert [i for _, ids, _ in sorted(parts) for i in ids] == want
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert {(r[0], r[1]) for r in rows} == set(whole)


def test_round_trip_and_edges(spark):
    odd = "a  b\n c \t d <|endoftext|> e\n\n f   g"
    rows = [
        (1, "Hello world, it's me.\nNew line", "x", 1), (2, None, "y", None), (3, "", None, 3), (4, odd, "z", 4),
        (None, "no id at all", "n", 5), (5, "same text", "s", 6), (5, "same text", "s", 6), (6, "été naïve ß 你好 " * 900, "long", 7),
        (7, "x" * 5000, "word", 8), (8, " lead", "", 0), (9, "trail ", "", 0), (10, "a b  c", "", 0), (11, "\n", "", 0), (12, " ", "", 0),
    ]
    check(rows, packed(spark, rows, length=64), 64)
    check(rows, packed(spark, rows), packing.SEQUENCE)


def test_empty_table(spark):
    assert packed(spark, []) == []


def test_documents_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    found = defaultdict(list)
    for r in packing.op4_hilbert_packing(spark, "/root/testdata/sf0.001").collect():
        found[r.doc_id].append(r)
    assert set(found) == set(rows)
    for doc, parts in found.items():
        ids = plain_ids(rows[doc])
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_hilbert_neighbours_touch():
    grid = np.array([[a, b] for a in range(8) for b in range(8)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert len(set(packing.hilbert(grid, 3))) == 64
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()

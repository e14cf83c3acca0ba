"""Substring dedup by banded MinHash over paragraphs.

Texts have no reliable paragraph marks, and a passage may sit anywhere in a longer line. So a paragraph ends
where its words say so: before a word that, hashed with the word before it, is less than its seven neighbours on
either side. A passage of over 50 words thus has the same inner paragraphs wherever it stands.

A paragraph's MinHash is bottom-k: the least hashes of its five-word shingles, each a band of its own. How many
there are is tuned to the paragraph: as many as make two paragraphs of similarity 0.8 share one for certain, a
fifth of the shingles and one. Colliding paragraphs are verified by exact Jaccard similarity of their shingles, and the connected
components of what holds are the classes, of which the first occurrence stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, release, ship, staged, table, trim
from .linking import GROUP_ITEMS, linked
from .near_dedup import SHINGLE, SIMILARITY
from .substring_tree import keyed
from .words import CHUNK, hashed_words, mix, shingles

#: Neighbours on either side that a paragraph's first word is less than; a paragraph has more words than that.
REACH = 7

_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)


def cuts_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where paragraphs begin in the words of several texts, which begin at ``first`` (the last entry is the end)."""
    n, counts = len(words), np.diff(first)
    at = np.arange(n) + REACH * (np.repeat(np.arange(len(counts)), counts) + 1)  # texts stand REACH places apart
    h = np.full(n + REACH * (len(counts) + 1), _MAX)
    if n:
        own = np.concatenate([[_MAX], mix(words[:-1] * _U(0xD1B54A32D192ED03) + words[1:])])
        own[first[:-1][counts > 0]] = _MAX  # a text's first word has none before it
        h[at] = own
        cut = own < _MAX
        for d in range(1, REACH + 1):
            cut &= (own < h[at - d]) & (own <= h[at + d])
        cut[first[:-1][counts > 0]] = True
        return np.flatnonzero(cut)
    return np.zeros(0, np.int64)


def paragraphs_of(texts: list[str], least: float = SIMILARITY, whole: bool = False) -> tuple[np.ndarray, ...]:
    """(text, name, start, end, size, bands, ends) of the paragraphs of more than REACH words of ``texts``.

    A paragraph has its text's number, a hash of its words, its place in characters and its number of different
    shingles; ``bands`` holds the bands of one after another, up to ``ends``: its least shingles, or all
    of them with ``whole``. A text of more than REACH words whose cuts leave too little everywhere is one paragraph.
    """
    parts = [hashed_words(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64)
    words, begin, end = (np.concatenate([p[k] for p in parts]) for k in range(3))
    cuts = cuts_of(words, first)
    stops = np.concatenate([cuts[1:], [len(words)]]) if len(cuts) else cuts
    text = np.searchsorted(first, cuts, side="right") - 1
    long = stops - cuts > REACH
    held = np.bincount(text, weights=long, minlength=len(texts)) > 0
    alone = ~held & (np.diff(first) > REACH)
    cuts, stops = np.concatenate([cuts[long], first[:-1][alone]]), np.concatenate([stops[long], first[1:][alone]])
    order = np.argsort(cuts, kind="stable")
    cuts, stops = cuts[order], stops[order]
    text = np.searchsorted(first, cuts, side="right") - 1
    n = stops - cuts
    if not len(cuts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none
    of = np.repeat(np.arange(len(cuts)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    placed = mix(words[np.repeat(cuts, n) + inside] + inside.astype(_U) * _U(0xA0761D6478BD642F))
    name = mix(np.add.reduceat(placed, np.cumsum(n) - n) + n.astype(_U))
    m = n - SHINGLE + 1
    h = mix(shingles(words, SHINGLE)[np.repeat(cuts, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)])
    of = np.repeat(np.arange(len(cuts)), m)
    order = np.lexsort((h, of))
    h = h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    h, of = h[new], of[new]
    size = np.bincount(of, minlength=len(cuts))
    if not whole:
        most = size - np.ceil(size * least - 1e-9).astype(np.int64) + 1
        keep = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size) < most[of]
        h, of = h[keep], of[keep]
    ends = np.cumsum(np.bincount(of, minlength=len(cuts)))
    return text, name.view(np.int64), begin[cuts], end[stops - 1], size, h.view(np.int64), ends


def _groups(texts: list[str]):
    """(number of texts before, texts) in groups of about CHUNK characters; a longer text is a group of its own."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield begin, texts[begin:k]
            begin, held = k, 0
        held += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))


def paragraphs(rows: DataFrame, least: float) -> DataFrame:
    """(k1, k2, id, key, start, end, size, bands) of the paragraphs of ``rows`` of keyed()."""
    ship(rows.sparkSession)

    def made(batches):
        for batch in batches:
            for before, texts in _groups(batch.column(3).to_pylist()):
                text, name, start, end, size, bands, ends = paragraphs_of(texts, least)
                at = pa.array(text + before)
                small = (pa.array(x.astype(np.int32)) for x in (start, end, size))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(name), *small, _lists(bands, ends)], names=["k1", "k2", "id", "key", "start", "end", "size", "bands"])
        trim()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("k1", "k2", "id", "text").mapInArrow(made, f"k1 long, k2 int, id {kind}, key long, start int, end int, size int, bands array<long>")


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, items): the different shingles of the paragraphs ``wanted`` (k1, k2, keys), read from their texts again."""

    def made(batches):
        for batch in batches:
            keys, own = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for before, texts in _groups(own):
                text, name, _, _, _, items, ends = paragraphs_of(texts, whole=True)
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                sets = [set(k) for k in keys[before : before + len(texts)]]
                pick = np.array([k in sets[t] for t, k in zip(text.tolist(), name.tolist(), strict=True)], dtype=bool)
                some = [items[a:b] for a, b in zip(begins[pick], ends[pick], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name[pick]), _lists(np.concatenate([np.zeros(0, np.int64), *some]), np.cumsum([len(s) for s in some], dtype=np.int64))], names=["key", "items"])
        trim()

    return rows.join(wanted, ["k1", "k2"]).select("text", "keys").mapInArrow(made, "key long, items array<long>")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, start, end, class_id, n_copies, removed) for every occurrence of a repeated paragraph.

    start and end are places in characters; class_id names the class; all of its occurrences but the first (by
    id, then place) are removed. Every repeated paragraph has its rows, however few words it shares with its neighbours.
    Texts of seven words or fewer, null and empty texts have no rows; rows alike repeat each other; null ids
    come last; an empty table gives no rows; other columns are not read.

    Texts are read once for all paragraphs and once more for those that collide with a different one. A
    paragraph of very many copies is one key while it is compared; hot bands, names and classes can be split in every join.
    """
    rows = keyed(docs, id_col, text_col)
    found = staged(paragraphs(rows, least))
    banded = found.select("key", "size", F.explode("bands").alias("band"))
    mixed = staged(banded.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("band"))
    multi = staged(hot_join(banded, mixed, "band").distinct())
    picked = hot_join(found.select("k1", "k2", "key"), multi.select("key").distinct(), "key").groupBy("key").agg(F.min(F.struct("k1", "k2")).alias("at"))
    wanted = picked.groupBy("at.k1", "at.k2").agg(F.collect_list("key").alias("keys"))
    sets = staged(shingle_sets(rows, wanted).dropDuplicates(["key"]))
    _, labels = linked(multi, sets, least, centre_from=GROUP_ITEMS)
    release(mixed, multi, sets)
    again = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    known = labels.select(F.col("node").alias("key"), F.col("component").alias("class_id"))
    named = staged(again.join(known, "key", "full").select("key", F.coalesce("class_id", "key").alias("class_id")))
    placed = staged(hot_join(found.drop("bands", "size"), named, "key"))
    release(found, named)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "start", "end")
    sizes = placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_copies"), F.min(order).alias("one"))
    joined = hot_join(placed, sizes, "class_id").withColumn("removed", order != F.col("one"))
    return joined.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "class_id", "n_copies", "removed")


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats(docs).withColumnRenamed("id", "doc_id")

"""Near-duplicate classes by DartMinHash.

A text is a weighted set: its shingles of five words with their counts. Every unit of weight of an element is a
region at which darts are thrown by hash, one after another in rank; a dart hits one coordinate of the
signature, and each coordinate keeps the earliest dart. Two texts agree in a coordinate with a probability equal
to their weighted Jaccard similarity, and the work for a text is one draw for each unit of weight and some
K * ln(K) darts, not K draws for each element. Signatures are joined in bands, candidates are verified exactly
on their unit regions and classes are the connected components of verified links.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, passed, release, staged, table
from .linking import linked
from .words import hashed_words, mix, shingles

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 5: a pair of similarity 0.8 shares none with a probability of 0.00007.
BANDS, ROWS = 24, 5
K = BANDS * ROWS

_U = np.uint64


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((h >> _U(11)).astype(np.float64) + 1) / (1 << 53)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words in lower case."""
    return hashed_words(text or "")[0]


def shingles_of(words: np.ndarray) -> np.ndarray:
    """A hash of every five consecutive words; a text of fewer words is one shingle, one without words none."""
    return shingles(words, SHINGLE)


def regions_of(elements: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The unit regions of a weighted set and the share of each that belongs to it.

    Without weights an element weighs as much as it occurs. A fractional weight ends in a partial region.
    """
    if weights is None:
        e = np.sort(elements)
        new = np.concatenate([[True], e[1:] != e[:-1]])
        at = np.arange(len(e)) - np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
        return mix(e + at.astype(np.uint64) * _U(0xD1B54A32D192ED03)), np.ones(len(e))
    whole = np.ceil(weights).astype(np.int64)
    at = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    share = np.minimum(1.0, np.repeat(weights, whole) - at)
    return mix(np.repeat(elements, whole) + at.astype(np.uint64) * _U(0xD1B54A32D192ED03)), share


def _darts(regions: np.ndarray, share: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(rank, hash) of all darts of rank at most ``reach``: a unit-rate Poisson stream for each region."""
    if len(regions) < 64:
        n = int(reach + 8 * reach**0.5 + 12)
        h = mix(regions[:, None] + np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        rank = np.cumsum(-np.log(_unit(h)), axis=1)
        keep = rank <= reach
        ranks, hashes, shares = rank[keep], h[keep], np.broadcast_to(share[:, None], h.shape)[keep]
    else:
        found, left, width, rank, k = [], regions, share, np.zeros(len(regions)), 1
        while len(left):
            h = mix(left + _U((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(_unit(h))
            keep = rank <= reach
            left, width, rank = left[keep], width[keep], rank[keep]
            found.append((rank, h[keep], width))
            k += 1
        ranks, hashes, shares = (np.concatenate(x) for x in zip(*found, strict=True))
    if (shares < 1).any():
        keep = _unit(mix(hashes ^ _U(0xA0761D6478BD642F))) <= shares
        ranks, hashes = ranks[keep], hashes[keep]
    return ranks, hashes


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """For each of ``k`` coordinates the earliest dart (its hash) that hits it."""
    regions, share = regions_of(elements, weights)
    reach = k * (np.log(k) + 3) / share.sum()
    while True:
        rank, h = _darts(regions, share, reach)
        at = (mix(h ^ _U(0xE7037ED1A0B428DB)) % _U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        out, hit = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[at[order]] = h[order]
        hit[at] = True
        if hit.all():
            return out
        reach *= 2


def bands_of(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    h = np.arange(bands, dtype=np.uint64)
    for i in range(rows.shape[1]):
        h = mix(h * _U(0x9E3779B97F4A7C15) + rows[:, i])
    return h.view(np.int64)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null text counts as the empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, bands) for every row; bands are empty for a text without words."""

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        seen: dict[str, np.ndarray] = {}
        out = []
        for text in batch.column(0).to_pylist():
            if text not in seen:
                s = shingles_of(words_of(text))
                seen[text] = bands_of(signature(s)) if len(s) else np.zeros(0, np.int64)
            out.append(seen[text])
        return [pa.array(out, pa.list_(pa.int64()))]

    keyed = docs.select(text_key(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("_t"))
    return passed(keyed, {"_text": F.col("_t")}, made, "bands array<long>", ["key", "id"]).select("_row.key", "_row.id", "bands")


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both)


def counted_shingles(text: str | None) -> Counter:
    w = (text or "").lower().split()
    return Counter(zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else Counter([tuple(w)] if w else [])


def regions(docs: DataFrame) -> DataFrame:
    """(key, items): the unit regions of each (key, text), by which texts are compared exactly."""

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [regions_of(shingles_of(words_of(t)))[0].view(np.int64) for t in batch.column(0).to_pylist()]
        ends = np.cumsum([0, *map(len, found)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))]

    return passed(docs, {"text": F.col("text")}, made, "items array<long>", ["key"]).select("_row.key", "items")


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, labels): every row's (key, id), verified links (a, b, similarity) that connect all alike among
    different texts, and the (node, component) of all texts that have some.

    Candidates share a band.
    """
    rows = staged(signed(docs, id_col, text_col))
    distinct = rows.groupBy("key").agg(F.min("id").alias("pick"), F.any_value("bands").alias("bands"))
    banded = staged(distinct.where(F.size("bands") > 0))
    each = banded.select("key", "pick", F.explode("bands").alias("band"))
    several = staged(each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"))
    multi = staged(hot_join(each, several, "band"))
    release(banded, several)
    keys = multi.select(F.col("key").alias("_key"), F.col("pick").alias("_pick")).distinct()
    # One row for each text: the one with the least id. Copies under one id are alike, so any of them will do.
    keyed = docs.select(text_key(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    picked = keyed.join(keys, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_pick")), "left_semi").select("key", "text")
    sets = staged(regions(picked).dropDuplicates(["key"]))
    sized = multi.select("band", "key").join(sets.select("key", F.size("items").alias("size")), "key")
    links, labels = linked(sized, sets, least)
    release(multi, sets)
    return rows.select("key", "id"), links, labels


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, id, class_key, class_id, keep) for every row: equal texts and chains of similar ones are a class.

    class_id is the least id of the class, and the text that has it is kept: keep marks its rows with that id.
    Texts without words are alike only if equal; null counts as empty; null ids come last; copies of whole rows
    are all in the result; an empty table gives no rows.
    """
    rows, _, labels = link(docs, id_col=id_col, text_col=text_col, least=least)
    known = labels.withColumnRenamed("node", "key")
    classed = rows.join(known, "key", "left").select("key", "id", F.coalesce("component", "key").alias("class_key"))
    classed = staged(classed)
    first = classed.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    return hot_join(classed, first, "class_key").select(
        "key", "id", "class_key", F.col("first.id").alias("class_id"), (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("keep")
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of every class, all columns as they were, whatever their names.

    Null and repeated ids, equal rows, null and empty texts and empty tables are treated as in classes(): one row of each class
    stays, of rows alike in id and text any one.
    """
    kept = classes(docs, id_col=id_col, text_col=text_col, least=least).where("keep")
    picks = staged(kept.groupBy(F.col("key").alias("pick_key"), F.col("id").alias("pick_id")).agg((F.count(F.lit(1)) > 1).alias("again")))
    rows = docs.select(text_key(F.col(f"`{text_col}`")).alias("own_key"), F.col(f"`{id_col}`").alias("own_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(picks, (F.col("own_key") == F.col("pick_key")) & F.col("own_id").eqNullSafe(F.col("pick_id")))
    met = staged(met.select("row", "own_key", "own_id", "again"))
    release(picks)
    once = met.where("again").dropDuplicates(["own_key", "own_id"])
    return met.where("not again").unionByName(once).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id", "keep")

"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text. The toxic one continues it with passages of toxic text: trained
apart on equal budgets, two dictionaries differ by chance more than by toxicity (README has the figures). A text is read in overlapping windows;
a window that the toxic dictionary shortens more than the ordinary one does speaks for toxicity. The differences
of all windows of a text are summed up in a few figures, which a logistic curve, fitted on labelled documents
that trained neither dictionary, turns into a probability.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import passed, table

WINDOW, STEP = 48, 24
ORDINARY_BYTES, TOXIC_PASSAGES, GRAM = 24_000, 600, 5
#: The labelled sample that is fitted on: at most so many documents and bytes of each class. All other steps
#: read every row.
SAMPLE_DOCS, SAMPLE_BYTES = 3_000, 6 << 20
FIELDS = "score double"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, figures: np.ndarray) -> np.ndarray:
        z = np.clip((figures - self.center) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _compressor(content: bytes):
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=6, target_length=64, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress


def windows_of(text: str) -> list[bytes]:
    """All of the text, lower-cased, in windows of 48 bytes that overlap by half."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - WINDOW + STEP), STEP)]


def figures_of(text: str, ordinary, toxic) -> list[float]:
    gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows_of(text)], dtype=float)
    n = len(gain)
    top = np.sort(gain)[-3:]
    return [gain.mean(), gain.max(), top.mean(), *((gain >= k).sum() / n**0.5 for k in (2, 3, 4, 6)), *(np.log1p((gain >= k).sum()) for k in (3, 5)), np.log(n)]


N_FIGURES = 10


def _passages(text: str, telling: set[str]) -> list[bytes]:
    """The stretches of ``text`` that telling character groups cover, with one character on each side."""
    at = [i for i in range(len(text) - GRAM + 1) if text[i : i + GRAM] in telling]
    out, begin, end = [], None, 0
    for i in [*at, None]:
        if begin is not None and (i is None or i > end):
            out.append(text[max(0, begin - 1) : end + 1].encode("utf-8", "surrogatepass"))
            begin = None
        if i is not None:
            begin = i if begin is None else begin
            end = i + GRAM
    return out


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents.

    The ordinary one is trained on windows of ordinary texts. The toxic one holds the same base, so that plain
    words cost the same under both, followed by the passages that set the toxic texts apart: those made of
    character groups that far more toxic than ordinary texts contain.
    """
    toxic, ordinary = sorted({t.lower() for t in toxic}), sorted({t.lower() for t in ordinary})
    groups = lambda t: {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}
    in_toxic, in_ordinary = Counter(), Counter()
    for t in toxic:
        in_toxic.update(groups(t))
    for t in ordinary:
        in_ordinary.update(groups(t))
    ratio = max(1, len(ordinary)) / max(1, len(toxic))
    least = max(3, len(toxic) // 100)
    telling = {g for g, c in in_toxic.items() if c >= least and c * ratio >= 15 * (in_ordinary[g] + 0.5)}
    found = Counter(p for t in toxic for p in _passages(t, telling))
    passages = [p for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:TOXIC_PASSAGES]]
    windows = [w for t in ordinary for w in windows_of(t)]
    try:
        base = zstandard.train_dictionary(ORDINARY_BYTES, windows[:: max(1, len(windows) // 60_000)]).as_bytes()[-(ORDINARY_BYTES - 300) :]
    except zstandard.ZstdError:  # too little text to train on
        base = b" ".join(windows)[-ORDINARY_BYTES:]
    base = base or b" " * 8
    return base, base + b"\n" + b"\n".join(reversed(passages))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - center) / scale, -8, 8)])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w


def train(labelled: list[tuple[str, str, int]]) -> Model:
    """Fit on (id, text, toxic) rows. Two thirds of them, by checksum of the id, train the dictionaries, the rest
    the curve. Without labels of both classes, every text scores 0."""
    rows = sorted(labelled)
    part = [zlib.crc32(i.encode()) // 5 % 3 > 0 for i, *_ in rows]
    base, toxic = dictionaries([t for p, (_, t, y) in zip(part, rows, strict=True) if p and y == 1], [t for p, (_, t, y) in zip(part, rows, strict=True) if p and y == 0])
    a, b = _compressor(base), _compressor(toxic)
    rest = [(t, y) for p, (_, t, y) in zip(part, rows, strict=True) if not p]
    if len({y for _, y in rest}) < 2:
        flat = np.zeros(N_FIGURES)
        return Model(base, toxic, flat, flat + 1, np.array([-30.0, *flat]))
    x = np.array([figures_of(t, a, b) for t, _ in rest])
    center, scale, w = _logistic(x, np.array([y for _, y in rest], dtype=float))
    return Model(base, toxic, center, scale, w)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, docs_per_class: int = SAMPLE_DOCS, bytes_per_class: int = SAMPLE_BYTES) -> list[tuple[str, str, int]]:
    """A bounded sample of labelled documents outside the held-out fifth, in the order of a hash of the id.

    An id counts once: of several texts the least, and one with labels of both classes not at all. Null ids and
    texts and labels other than 0 and 1 are passed over; no labels or an empty table give no sample.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = []
    for y in (0, 1):
        some = known.where(F.col("toxic") == y).select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(docs_per_class)
        # Ids and sizes come first, so that the texts fetched stay within the bound in bytes.
        held = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        sized = held.select("doc_id", F.octet_length("text").alias("n")).collect()
        ids, room = [], bytes_per_class
        for _, doc, n in sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, r.n) for r in sized):
            if n <= room:
                ids.append(doc)
                room -= n
        chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {kind}")
        found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows += [(str(r.doc_id), r.text, y) for r in found.collect()]
    return rows


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row as struct ``_row`` with its score. Only the text enters the score.

    Null and empty texts are one empty window; very long ones are read whole, window by window; ids may be null,
    tied or repeated; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def scored(batch: pa.RecordBatch) -> list[pa.Array]:
        m = held.value
        a, b = _compressor(m.ordinary), _compressor(m.toxic)
        texts = batch.column(0).to_pylist()
        x = np.array([figures_of(t or "", a, b) for t in texts]).reshape(len(texts), N_FIGURES)
        return [pa.array(m.score(x), pa.float64())]

    return passed(docs, {"_text": text_col}, scored, FIELDS, keep)


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, model, keep=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        # A null id counts as the empty text; nothing is learned from it.
        (F.crc32(F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

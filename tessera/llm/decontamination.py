"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are cut into windows of ten words; an automaton over all windows reads each normalised text
once and reports every occurrence, whose place is mapped back to the original text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import passed, staged, table

#: Bytes that belong to words once A-Z is lower-cased: digits, a-z and everything beyond ASCII.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 10
#: Benchmark text that one automaton may hold; more is scanned in several rounds, each of this size at most.
AUTOMATON_BYTES = 64 << 20

_built: dict[str, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, int]]:
    """(window, its number of words): ``size`` consecutive words, or all of a shorter text."""
    if not words:
        return []
    n = min(size, len(words))
    return [(b" ".join(words[i : i + n]), n) for i in range(len(words) - n + 1)]


def _automaton(key: str, items: list[tuple[str, str]], size: int) -> tuple:
    """The automaton and, for each window, its length and items; built once in each worker."""
    if key not in _built:
        import ahocorasick

        ids: dict[bytes, int] = {}
        held: list[tuple[int, set[str]]] = []
        for item, text in items:
            for window, n in windows_of(words_of(text), size):
                at = ids.setdefault(window, len(held))
                if at == len(held):
                    held.append((n, set()))
                held[at][1].add(item)
        machine = ahocorasick.Automaton()
        for window, at in ids.items():
            machine.add_word(f" {window.decode('latin-1')} ", at)
        if held:
            machine.make_automaton()
        _built.clear()
        _built[key] = (machine if held else None, held)
    return _built[key]


def _places(text: str, runs: list[dict]) -> list[dict]:
    """The runs of hit words as spans [start, end) in characters of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = np.array([m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD))], dtype=np.int64)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    return [{"start": int(chars[at[r["start"], 0]]), "end": int(chars[at[r["end"] - 1, 1]])} for r in runs]


FOUND = "n_words long, n_hit long, items array<string>, runs array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>"
_PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _edges(hit: np.ndarray) -> list[dict]:
    at = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(at[::2], at[1::2], strict=True)]


def _scan_round(docs: DataFrame, text: Column | str, keep: list[str], before: dict[str, Column], items: list[tuple[str, str]], size: int) -> DataFrame:
    """One pass over ``docs``; ``before`` holds the items and word runs that earlier rounds have found."""
    held = docs.sparkSession.sparkContext.broadcast(items)  # at most automaton_bytes of text
    key = hashlib.sha256(repr((size, items)).encode("utf-8", "surrogatepass")).hexdigest()

    def found(batch: pa.RecordBatch) -> list[pa.Array]:
        machine, windows = _automaton(key, held.value, size)
        texts = batch.column(0).to_pylist()
        old = zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True) if batch.num_columns > 1 else ((None, None) for _ in texts)
        n_words, n_hit, names, runs, spans = [], [], [], [], []
        for text, (old_items, old_runs) in zip(texts, old, strict=True):
            words = words_of(text)
            hit, here = None, set(old_items or ())
            for run in old_runs or ():
                hit = np.zeros(len(words), bool) if hit is None else hit
                hit[run["start"] : run["end"]] = True
            if machine is not None and words:
                line, gaps = b" ".join(words).join((b" ", b" ")), None
                for end, at in machine.iter(line.decode("latin-1")):
                    if gaps is None:
                        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                        hit = np.zeros(len(words), bool) if hit is None else hit
                    last = int(np.searchsorted(gaps, end))
                    n, of = windows[at]
                    hit[last - n : last] = True
                    here |= of
            n_words.append(len(words))
            n_hit.append(0 if hit is None else int(hit.sum()))
            names.append(sorted(here))
            runs.append([] if hit is None else _edges(hit))
            spans.append([] if hit is None else _places(text, runs[-1]))
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(runs, _PAIRS), pa.array(spans, _PAIRS)]

    return passed(docs, {"_text": text, **before}, found, FOUND, keep)


def scan(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, keep: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` as struct ``_row`` (all its columns, or those in ``keep``), with n_words, n_hit, items, and the hit runs as words and as
    character spans of the original text.

    The benchmark's size is measured first. It is sent to the executors whole while it is at most
    ``automaton_bytes``; a larger one goes in rounds of about that size over the same rows, each adding to what
    was found before, so memory stays bounded and no window is left out.

    Null or empty texts have no words and no hits; null item texts have no windows, and a null item id counts
    as the empty string; repeated rows and items stay as they are; empty tables give no rows or no hits.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = max(1, -(-total // automaton_bytes))
    keep = docs.columns if keep is None else keep
    if rounds > 1:
        keep = [*keep, *([] if text_col in keep else [text_col])]
    result = None
    for k in range(rounds):
        part = items if rounds == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == k)
        rows = sorted((r[0], r[1]) for r in part.collect())
        if result is None:
            result = _scan_round(docs, text_col, keep, {}, rows, window)
        else:
            again = _scan_round(staged(result), F.col(f"_row.`{text_col}`").cast("string"), result.columns, {"_items": F.col("items"), "_runs": F.col("runs")}, rows, window)
            result = again.select(F.col("_row._row").alias("_row"), "n_words", "n_hit", "items", "runs", "spans")
    return result


def cut(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without benchmark passages: hit words go from the texts, and a text of hits only goes whole.

    Columns and clean rows stay as they are.
    """
    found = scan(docs, benchmark, **options)
    text = options.get("text_col", "text")
    # What lies between one span's end and the next one's start stays.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(F.col(f"_row.`{text}`")).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(F.col(f"_row.`{text}`"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    clean = F.when(F.size("spans") > 0, F.array_join(kept, "")).otherwise(F.col(f"_row.`{text}`"))
    return found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))).select(
        *[(clean if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, low),
b AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) x(i) WHERE len(w) > 0),
pos AS (SELECT k, i, n, w[i:i + n - 1] AS g FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) x(i)),
occ AS (SELECT k, i, n, item_id FROM pos JOIN win USING (n, g)),
hit AS (SELECT k, count(DISTINCT i + o) AS n_hit FROM occ, unnest(range(n)) r(o) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM occ) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""

"""Removal of repeated byte strings by the common-prefix interval tree of a sparse suffix array.

A byte goes if a string of 200 bytes that covers it starts anywhere else too. Suffixes are taken at anchors
only: the positions whose 40-byte hash is least in some window of 161 positions. Which anchors a 200-byte string
holds depends on that string alone, so equal strings meet at equal anchors, and about one suffix in eighty of the
full suffix array is enough.

Anchors that occur once are dropped. Where all occurrences of an anchor have the same surroundings, everything
around them is repeated. For the rest the suffixes of an anchor, once for each distinct surroundings, are sorted;
a stack scan over the common prefixes of neighbours yields the tree of prefix intervals, each a repeat with all
its occurrences. In an interval the occurrences' left sides, sorted from the anchor outwards, tell how far each
extends to the left together with another one: left extension is diverse where neighbours differ. Left and right
extension together decide what is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, passed, release, staged, table, trim

LENGTH, GRAM = 200, 40
REACH = LENGTH - GRAM  # positions of an anchor in a string of LENGTH bytes, less one
#: Distinct surroundings of one anchor that one task sorts (some 360 bytes each); more are counted string by string.
GROUP = 65_536
#: Bytes that are searched for anchors at once; some 80 bytes each are held meanwhile.
CHUNK = 1 << 17

_tables: dict[str, np.ndarray] = {}
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "power" not in _tables or len(_tables["power"]) < n:
        n = max(n, CHUNK + 2 * LENGTH)
        mixed = (np.arange(256, dtype=np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03)
        mixed = (mixed ^ (mixed >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        _tables["byte"] = mixed ^ (mixed >> _U(32))
        inverse = pow(_BASE, -1, 1 << 64)
        _tables["power"] = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_BASE))]))
        _tables["inverse"] = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(inverse))]))
    return _tables["byte"], _tables["power"], _tables["inverse"]


def _sliding(x: np.ndarray, w: int, pick: np.ufunc, rest: int) -> np.ndarray:
    """``pick`` over every ``w`` consecutive entries, by running picks forwards and backwards in blocks of ``w``."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, _U(rest))
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


def anchors_of(raw: bytes, chunk: int = CHUNK) -> np.ndarray:
    """Positions whose hash of GRAM bytes is least among the GRAMs of some string of LENGTH bytes; ties all count.

    A position depends on its LENGTH bytes on either side only, so long texts are read in overlapping chunks.
    """
    if len(raw) <= chunk + 2 * LENGTH:
        return _anchors(raw)
    out = []
    for a in range(0, len(raw), chunk):
        lo = max(0, a - REACH)
        at = _anchors(raw[lo : a + chunk + LENGTH]) + lo
        out.append(at[(at >= a) & (at < a + chunk)])
    return np.concatenate(out)


def _anchors(raw: bytes) -> np.ndarray:
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    byte, power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[np.frombuffer(raw, np.uint8)] * power[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[: n - GRAM + 1]) * inverse[: n - GRAM + 1]
    h ^= h >> _U(31)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(29)
    w = REACH + 1
    least = _sliding(h, w, np.minimum, 0xFFFFFFFFFFFFFFFF)
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(_sliding(padded, w, np.maximum, 0) == h)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def keyed(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """(k1, k2, id, text): 96 bits of hash name a row; rows alike in id and text share it and their fate.

    With ``whole``, id is the struct of all columns, which then travel along.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]) if whole else F.col(f"`{id_col}`")
    one = docs.select(F.col(f"`{id_col}`").alias("_name"), row.alias("id"), text.alias("text"))
    return one.select(F.xxhash64("_name", "text").alias("k1"), F.hash("text", "_name").alias("k2"), "id", "text")


def anchored(rows: DataFrame) -> DataFrame:
    """(k1, k2, gram, around, pos): hashes of each anchor's first GRAM bytes and of its whole surroundings."""

    def made(batches):
        for batch in batches:
            row, gram, around, pos = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for p in anchors_of(raw).tolist():
                    lo = p - REACH if p > REACH else 0
                    row.append(k)
                    gram.append(_signed(xxhash.xxh3_64_intdigest(raw[p : p + GRAM])))
                    around.append(_signed(xxhash.xxh3_64_intdigest(raw[lo : p + LENGTH], p - lo)))
                    pos.append(p)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(gram, pa.int64()), pa.array(around, pa.int64()), pa.array(pos, pa.int32())],
                names=["k1", "k2", "gram", "around", "pos"],
            )
        trim()

    return rows.select("k1", "k2", "text").mapInArrow(made, "k1 long, k2 int, gram long, around long, pos int")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(suffixes: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every prefix interval of sorted ``suffixes``, children before parents."""
    stack: list[list[int]] = []  # [common prefix, first]
    for i in range(1, len(suffixes) + 1):
        shared = _common(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else -1
        first = i - 1
        while stack and stack[-1][0] > shared:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append([shared, first])


def repeats(left: list[bytes], right: list[bytes], times: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """How far around its anchor each occurrence is covered by repeated strings: (bytes to the left, to the right).

    ``left`` are the bytes before the anchor, from the anchor outwards; ``right`` those from the anchor on;
    ``times`` how often the pair occurs.
    """
    out = [[0, 0] for _ in left]
    for k, n in enumerate(times):
        if n > 1 and len(left[k]) + len(right[k]) >= length:
            out[k] = [len(left[k]), len(right[k])]
    order = sorted(range(len(right)), key=right.__getitem__)
    for depth, first, last in intervals([right[k] for k in order]):
        members = sorted(order[first : last + 1], key=left.__getitem__)
        shared = [_common(left[a], left[b]) for a, b in zip(members, members[1:])]
        for at, k in enumerate(members):
            most = max(shared[at - 1] if at else 0, shared[at] if at < len(shared) else 0)
            if most + depth >= length:
                out[k][0] = max(out[k][0], most)
                out[k][1] = max(out[k][1], depth)
    return [(a, b) for a, b in out]


def _in_groups(contexts: DataFrame) -> DataFrame:
    """(gram, around, left, right) by the interval tree of each anchor's surroundings."""

    def grown(batches):
        def done(group):
            cover = repeats([g[1] for g in group], [g[2] for g in group], [g[3] for g in group])
            return [(gram, g[0], a, b) for g, (a, b) in zip(group, cover, strict=True) if b]

        gram, group, out = None, [], []
        for batch in batches:
            for g, around, before, after, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != gram:
                    out += done(group) if len(group) > 1 else []
                    gram, group = g, []
                if group and group[-1][0] == around:
                    continue  # rows alike in id and text give the same bytes twice
                group.append((around, before[::-1], after, n))
            if len(out) > 10_000:
                yield _cover(out)
                out = []
        yield _cover(out + (done(group) if len(group) > 1 else []))
        trim()

    laid = contexts.repartition("gram").sortWithinPartitions("gram", "around")
    return laid.select("gram", "around", "before", "after", "n").mapInArrow(grown, "gram long, around long, left int, right int")


def _cover(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["gram", "around", "left", "right"])


def _string_by_string(contexts: DataFrame) -> DataFrame:
    """The same for anchors of very many surroundings: every string of LENGTH bytes around them is counted.

    A plain aggregation with partial sums, so no task holds such an anchor's occurrences.
    """
    whole = contexts.select("gram", "around", "n", F.length("before").alias("b"), F.concat("before", "after").alias("w"))
    strings = whole.select(
        "gram", "around", "n", "b", F.posexplode(F.transform(F.sequence(F.lit(0), F.least(F.col("b"), F.length("w") - LENGTH)), lambda i: F.unhex(F.md5(F.substring("w", i + 1, F.lit(LENGTH)))))).alias("o", "s")
    ).where(F.length("w") >= LENGTH).withColumn("back", F.col("b") - F.col("o"))
    again = strings.groupBy("gram", "back", "s").agg(F.sum("n").alias("t")).where("t > 1").select("gram", "back", "s")
    met = strings.join(again, ["gram", "back", "s"])
    return met.groupBy("gram", "around").agg(F.max("back").cast("int").alias("left"), F.max(LENGTH - F.col("back")).cast("int").alias("right"))


def _contexts(reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes around one occurrence of each (gram, around)."""
    listed = reps.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "around", "pos", "n")).alias("at"))
    joined = rows.join(listed, ["k1", "k2"]).select("id", "text", "at")

    def cut(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for a in at:
                    p = a["pos"]
                    for col, v in zip(cols, (a["gram"], a["around"], raw[max(0, p - REACH) : p], raw[p : p + LENGTH], a["n"]), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["gram", "around", "before", "after", "n"])

    return joined.mapInArrow(cut, "gram long, around long, before binary, after binary, n long")


def removals(rows: DataFrame, *, group: int = GROUP) -> DataFrame:
    """(k1, k2, spans): for ``rows`` of keyed(), the byte ranges around their anchors that are repeated.

    Anchors of a hot string are many rows of one key: they meet counts and verdicts in joins that can split them.
    """
    anchors = anchored(rows)
    often = staged(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi")).where("n > 1"))
    shared = staged(hot_join(anchors, often, "gram").select("k1", "k2", "gram", "around", "pos", (F.col("lo") != F.col("hi")).alias("mixed")))
    release(often)
    mixed = shared.where("mixed")
    reps = mixed.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("one"))
    reps = staged(reps.select("gram", "around", "n", "one.k1", "one.k2", "one.pos"))
    large = reps.groupBy("gram").count().where(F.col("count") > group).select("gram")
    if large.isEmpty():
        covered = _in_groups(_contexts(reps, rows))
    else:
        large = staged(large)
        covered = _in_groups(_contexts(reps.join(large, "gram", "left_anti"), rows)).unionByName(_string_by_string(_contexts(reps.join(large, "gram", "left_semi"), rows)))
    covered = staged(covered)
    whole = shared.where("not mixed").select("k1", "k2", "pos", F.lit(REACH).alias("left"), F.lit(LENGTH).alias("right"))
    partly = mixed.join(covered, ["gram", "around"]).select("k1", "k2", "pos", "left", "right")
    # Staged, so that the shuffles behind it are gone before the texts are shuffled again for the last join.
    spans = whole.unionByName(partly).select("k1", "k2", F.struct((F.col("pos") - F.col("left")).alias("s"), (F.col("pos") + F.col("right")).alias("e")).alias("span"))
    out = staged(spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("span")).alias("spans")))
    release(shared, reps, covered)
    return out


def merged(spans: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Spans cut to [0, n) and to LENGTH bytes at least, as disjoint runs."""
    out: list[list[int]] = []
    for span in spans or ():
        s, e = max(0, span["s"]), min(n, span["e"])
        if e - s < LENGTH:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in runs:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]])


def _finished(docs: DataFrame, fn, kinds: list[pa.DataType], fields: str, *, id_col: str, text_col: str, group: int, whole: bool = False, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Each row as struct ``_row`` with what ``fn`` makes of its bytes and their runs to remove, a value for each field."""
    rows = keyed(docs, id_col, text_col, whole)
    joined = rows.join(removals(rows, group=group), ["k1", "k2"], "left")

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            out.append(fn(raw, merged(spans, len(raw))))
        return [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]

    return passed(joined.select("id", "text", "spans"), {"_text": "text", "_spans": F.col("spans")}, made, fields, list(keep))


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, text, runs) for every row: the whole text and the disjoint byte runs to remove from it.

    Strings are judged on the input; overlapping and self-overlapping ones count; matches never cross texts. Null
    and empty texts and those under 200 bytes have no runs; rows alike repeat each other and lose all their
    bytes; very long texts are searched in chunks; an empty table gives no rows; other columns are not read.
    """
    kinds = [pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
    listed = lambda raw, runs: ([{"s": s, "e": e} for s, e in runs],)
    done = _finished(docs, listed, kinds, "runs array<struct<s:int,e:int>>", id_col=id_col, text_col=text_col, group=group, keep=("id", "text"))
    return done.select("_row.id", "_row.text", "runs")


def stripped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``docs`` with its columns, texts without their repeated strings; what a cut leaves of a split character goes too.

    Texts that lose nothing stay as they are; a null text becomes the empty one; texts that lose all go whole. Other
    cases as in remove().
    """

    def cut(raw: bytes, runs: list[tuple[int, int]]) -> tuple[str, bool]:
        text = without(raw, runs).decode("utf-8", "ignore" if runs else "surrogatepass")
        return text, bool(runs) and not text.strip()

    done = _finished(docs, cut, [pa.string(), pa.bool_()], "text string, gone boolean", id_col=id_col, text_col=text_col, group=group, whole=True).where("not gone")
    return done.select(*[(F.col("text") if c == text_col else F.col(f"_row.id.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): what remove() finds, in figures."""

    def figures(raw: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, str]:
        kept = without(raw, runs)
        return len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out = _finished(docs, figures, kinds, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col=id_col, text_col=text_col, group=group)
    return out.select("_row.id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_prefix_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs).withColumnRenamed("id", "doc_id")

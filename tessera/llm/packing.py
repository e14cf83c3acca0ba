"""Packing along a space-filling curve.

Each document's token ids are hashed and projected to a few dimensions; the point's place on a Hilbert curve
orders the documents, so that neighbours on the curve resemble each other. Range partitions of that order are
then filled front to back into sequences, documents being cut where a sequence is full.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import passed, staged, table, trim

#: The tokenizer's files, the separator that ends each document, the sequence length.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 1
SEQUENCE = 2048
DIMENSIONS, BITS = 4, 12
#: Entries of a worker's cache of pieces; at that size it starts afresh.
CACHE = 400_000

_loaded: dict = {}
_BESIDE = re.compile(r" \s|\s ")


class Pieces(dict):
    """Ids (16-bit, little-endian) of the pieces between spaces, filled as they are met."""

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers as known
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(json_path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.plain = tiktoken.Encoding("same-vocabulary", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = np.array(self.plain(piece), "<u2").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """A space that has no white space beside it always begins a new piece, so pieces can be encoded apart.

        Texts with other white space next to a space, or with a special token's string, go to the tokenizer whole.
        """
        if _BESIDE.search(text) or any(t in text for t in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join(map(self.__getitem__, [f" {x}" for x in rest]))


def _pieces(json_path: str, ranks_path: str) -> Pieces:
    key = (json_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = Pieces(json_path, ranks_path)
    return _loaded[key]


def projection(vocabulary: int = 1 << 16, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed sign for each (id, dimension): the random projection of a hashed bag of ids."""
    mixed = (np.arange(vocabulary * dimensions, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.where(mixed >> np.uint64(63), 1.0, -1.0).astype(np.float32).reshape(vocabulary, dimensions)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) in [0, 2**bits), by Gray-code reflection from the top bit down."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    place = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def tokenized(docs: DataFrame, json_path: str, ranks_path: str, *, text_col: str = "text", end_id: int = END_ID, keep: list[str] | None = None) -> DataFrame:
    """Each row as struct ``_row`` with n_tokens, ids (16-bit little-endian, end id included) and place on the curve."""

    def encoded(batch: pa.RecordBatch) -> list[pa.Array]:
        pieces = _pieces(json_path, ranks_path)
        if "signs" not in _loaded:
            _loaded["signs"] = projection()
        signs, end = _loaded["signs"], np.array([end_id], "<u2").tobytes()
        ids = [pieces.encode(t or "") + end for t in batch.column(0).to_pylist()]
        n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
        if not len(ids):
            place = np.zeros(0, np.int64)
        else:
            flat, starts = np.frombuffer(b"".join(ids), "<u2"), np.concatenate([[0], np.cumsum(n)[:-1]])
            sums = np.empty((len(n), signs.shape[1]))
            for d in range(signs.shape[1]):
                sums[:, d] = np.add.reduceat(signs[flat, d], starts)
            # A mean of signs lies near 0; its root spreads it over the grid.
            mean = sums / n[:, None]
            unit = (np.sign(mean) * np.sqrt(np.abs(mean)) + 1) / 2
            place = hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
        return [pa.array(n), pa.array(ids, pa.binary()), pa.array(place)]

    return passed(docs, {"_text": text_col}, encoded, "n_tokens long, ids binary, place long", keep)


PIECE = "start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, json_path: str, ranks_path: str, *, text_col: str = "text", id_col: str = "doc_id", length: int = SEQUENCE,
    end_id: int = END_ID, keep: list[str] | None = None, with_ids: bool = True,
) -> DataFrame:
    """Pieces of all rows: struct ``_row`` (all columns, or those in ``keep``) with start, length, ids (null unless
    ``with_ids``), the CRC-32 of the ids as 32-bit little-endian integers, doc_tokens, sequence_id and offset.

    The encoded documents are staged once (2 bytes a token) and range-partitioned by (place on the curve, hash
    of the id), so documents of one place, such as copies of one text, spread over partitions too. Each
    partition fills its sequences gaplessly; at most one sequence of a partition ends short. A document longer
    than a sequence is cut over several; memory holds one batch and one open sequence.

    Null and empty texts become the end id alone; null and repeated ids and rows are packed like others; an
    empty table gives no pieces.
    """
    coded = staged(tokenized(docs, json_path, ranks_path, text_col=text_col, end_id=end_id, keep=docs.columns if keep is None else keep))
    tie = F.xxhash64(F.col(f"_row.`{id_col}`"), "n_tokens")
    laid = coded.withColumn("_tie", tie).repartitionByRange("place", "_tie").sortWithinPartitions("place", "_tie", F.col(f"_row.`{id_col}`"), "ids")
    laid = laid.select("_row", "n_tokens", "ids")
    out = T.StructType([coded.schema["_row"], *T.StructType.fromDDL(PIECE).fields])

    def filled(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(out)
        sequence, free = TaskContext.get().partitionId() << 40, length
        for batch in batches:
            row, cols = [], [[] for _ in range(7)]
            for k, (n, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = 0
                while at < n:
                    if not free:
                        sequence, free = sequence + 1, length
                    take = min(free, n - at)
                    piece = ids[2 * at : 2 * (at + take)]
                    row.append(k)
                    crc = zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4").tobytes())
                    for col, v in zip(cols, (at, take, piece if with_ids else None, crc, n, sequence, length - free), strict=True):
                        col.append(v)
                    at, free = at + take, free - take
            rest = [pa.array(c, made.field(i + 1).type) for i, c in enumerate(cols)]
            rows = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.cast(made.field(0).type) if rows.type != made.field(0).type else rows, *rest], names=made.names)
        trim()

    return laid.mapInArrow(filled, out)


def digest(docs: DataFrame, json_path: str, ranks_path: str) -> DataFrame:
    """doc_id and places of the pieces of pack(), with the checksums of their ids."""
    return pack(docs, json_path, ranks_path, keep=["doc_id"], with_ids=False).select("_row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs, *tokenizer_paths())

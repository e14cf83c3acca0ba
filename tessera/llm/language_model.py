"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Words have an open vocabulary. Every pair of neighbouring words of every trusted text is counted; its discounted share of
its first word is interpolated with the second word's, which counts the different words it follows, and that with the
probability of its spelling, which a model of order 4 over a closed alphabet of symbols gives. Pairs and words grow with
the corpus, stay sharded, and are joined with those that each document asks for; only the spelling model, 48**4
n-grams at most, is one table of 21 MB that every executor has.

Each n-gram seen has one number, its gain: what it adds to the log probability of a text in which it was thought unseen.
For a pair that is log p(b | a) - log weight(a) p(b); for a word, log p(b) less that of its spelling, and the log of the
weight that it leaves to unseen pairs. So a text's log probability is that of its spellings and the sum of its n-grams' gains,
which shards give apart.

A quarter of the trusted documents is held out of the counts; a quantile of its perplexities bounds those of a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, release, ship, staged, table, trim
from .word_grams import START, Words, paired, spelled, words_of

SYMBOLS, ORDER = 48, 4
#: The order of the word model: 2 for pairs, 1 for words alone.
WORDS = 2
SPACE, DIGIT, CAPITAL, LETTER, LETTERS, MARK, REPEAT, BREAK, OTHER = 0, 27, 28, 29, 8, 37, 45, 46, 47
#: Punctuation, each group with a symbol of its own.
MARKS = (".", ",", ";:!?", "'\"", "-()", "|", "#*$%&")
#: Verdict: the log perplexity's distance from its language's median may be so many times that of the 0.99 quantile: once, so the bound is the quantile.
QUANTILE, SLACK = 0.99, 1.0
#: One trusted document in so many sets the quantiles and isn't counted.
HELD_OUT = 4
#: Bounds of so many languages are broadcast at most.
LANGUAGES = 10_000
#: Symbols of ordinary text that every document's mean is blended with: short texts say little.
PRIOR = 64


def alphabet() -> np.ndarray:
    """The symbol of each character of the basic plane: a-z apart, capitals as one, other letters by 8 classes."""
    of = np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if c > 127 and ch.isalpha():
            of[c] = LETTER + c % LETTERS
        elif ch.isspace():
            of[c] = SPACE
        elif ch.isdigit():
            of[c] = DIGIT
    of[65:91] = CAPITAL
    of[97:123] = np.arange(1, 27)
    for k, group in enumerate(MARKS):
        of[[ord(ch) for ch in group]] = MARK + k
    of[ord("\n")] = BREAK
    return of


_shared: dict = {}


def read(texts: list[str]) -> Words:
    if "alphabet" not in _shared:
        _shared["alphabet"] = alphabet()
    return words_of(texts, _shared["alphabet"], SPACE, REPEAT, (SPACE, BREAK))


#: Characters that are read at once; some 60 bytes each are held meanwhile.
CHUNK = 1 << 20
_SPACE = re.compile(r"\s")


def chunks_of(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, texts) in groups of about CHUNK characters; a longer text comes in parts, cut before white space."""
    held, some, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            to = at + CHUNK
            found = _SPACE.search(text, to) if to < len(text) else None
            part = text[at : found.start() if found else len(text)]
            if some and size + len(part) > CHUNK:
                yield held, some
                held, some, size = [], [], 0
            held.append(k)
            some.append(part)
            size += len(part)
            at += max(1, len(part))
    if some:
        yield held, some


#: Different words that a task sums up, or n-grams that it asks for, at once.
HELD = 1 << 21


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), minlength=len(found)).astype(np.int64)


def counted(trusted: DataFrame, text: Column, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(kind, gram, n): how often all trusted texts have each word (kind 1, by name) and each 4-gram of spellings (kind 0); each task first sums up its own."""

    def run(batches):
        held = {kind: ([], []) for kind in kinds}

        def flushed(kind):
            keys, n = _sums(*held[kind])
            held[kind] = ([], [])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "gram", "n"])

        for batch in batches:
            for _, texts in chunks_of([t or "" for t in batch.column(0).to_pylist()]):
                w = read(texts)
                for kind in kinds:
                    keys = w.name.view(np.int64) if kind else spelled(w.symbols, w.begin, w.end, SYMBOLS)[0]
                    found, n = np.unique(keys, return_counts=True)
                    held[kind][0].append(found)
                    held[kind][1].append(n)
                    if sum(map(len, held[kind][0])) > HELD:
                        keys, n = _sums(*held[kind])
                        held[kind] = ([keys], [n])
                        if len(keys) > HELD // 2:
                            yield flushed(kind)
        for kind in held:
            yield flushed(kind)
        trim()

    ship(trusted.sparkSession)
    return trusted.select(text.alias("_text")).mapInArrow(run, "kind int, gram long, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts for counts 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    return _discounted(*counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())


def _discounted(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k) for k, x in zip((0.95, 1.9, 2.9), d, strict=True))


@dataclass(frozen=True)
class Model:
    """Natural log of p(symbol | three before) for every 4-gram code, and of the share of words left to spelling.

    ``words`` is the order of the word model, whose gains lie in ``shards`` shards.
    """

    log_p: np.ndarray
    left: float = 0.0
    words: int = 1
    shards: int = 1

    def spellings(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different words, natural logs of their probabilities as spelled, and which of them each word is."""
        name, at, of = np.unique(w.name, return_index=True, return_inverse=True)
        code, start = spelled(w.symbols, w.begin[at], w.end[at], SYMBOLS)
        return name, np.add.reduceat(self.log_p[code].astype(np.float64), start) if len(start) else np.zeros(0), of


def train(trusted: DataFrame, text: Column, words: int = 1) -> tuple[Model, DataFrame]:
    """Fit on all rows of ``trusted``: the model, and the gains of words (and pairs, where ``words`` is 2) as blobs of kind 0.

    With no trusted text every symbol is equally likely and no word is known.
    """
    both = staged(counted(trusted, text, (0,)))
    counts = {ORDER: both.select("gram", "n")}
    for order in range(ORDER - 1, 0, -1):
        # Lower orders count in how many contexts an n-gram is seen.
        wider = counts[order + 1]
        counts[order] = wider.groupBy((F.col("gram") % SYMBOLS**order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    p = np.full(1, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        seen = counts[order]
        d1, d2, d3 = _discounts(seen)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        keyed = seen.withColumn("context", F.floor(F.col("gram") / SYMBOLS).cast("long"))
        contexts = keyed.groupBy("context").agg(F.sum("n").alias("all"), F.sum(off).alias("left"))
        # Counts of n-grams joined with those of their contexts, both sharded by the context.
        own = keyed.join(contexts, "context").select("gram", ((F.col("n") - off) / F.col("all")).alias("p")).toArrow()
        back = contexts.select("context", (F.col("left") / F.col("all")).alias("w")).toArrow()
        weight = np.ones(SYMBOLS ** (order - 1))
        weight[back["context"].to_numpy()] = back["w"].to_numpy()
        lower = np.broadcast_to(p, SYMBOLS) if order == 1 else np.tile(p, SYMBOLS)
        full = np.repeat(weight, SYMBOLS) * lower
        full[own["gram"].to_numpy()] += own["p"].to_numpy()
        p = full
    # Every word ends with a space, so their number bounds that of words.
    n = both.where((F.col("gram") % SYMBOLS).isin(SPACE, REPEAT)).agg(F.sum("n")).first()[0] or 0
    release(both)
    return _fitted(trusted, text, Model(np.log(p).astype(np.float32)), words, max(SHARDS, n // SHARD_PAIRS))


#: Counts of n-grams that were seen 1 to 4 times, of pairs; the same of words, the number of words and the sum of their counts.
_STATS = [f"s{i}" for i in range(10)]


def _fitted(trusted: DataFrame, text: Column, spelling: Model, words: int, dealt: int) -> tuple[Model, DataFrame]:
    """The word model: pairs are summed up by their second word, which the words' own probabilities need, then meet their first word's other pairs."""
    held = sent(trusted.sparkSession, spelling)
    pairs = staged(_merged(_met(_counted_pairs(trusted.select(text.alias("_text")), held, words, dealt), dealt), words))
    stats = [x or 0 for x in pairs.agg(*[F.sum(c) for c in _STATS]).first()]
    off_pair, off_word = _discounted(*stats[:4]), _discounted(*stats[4:8])
    n1, n2, types, total = stats[4], stats[5], stats[8], stats[9]
    left = float(np.log((off_word[0] * n1 + off_word[1] * n2 + off_word[2] * (types - n1 - n2)) / total)) if total else 0.0
    shards = -(-max(SHARDS, (total + types) // SHARD_WORDS) // ROUNDS) * ROUNDS
    gains = staged(_gains(_met(_followed(pairs, words, dealt, off_word, total, left), dealt), off_pair, shards))
    release(pairs)
    held.unpersist()
    return Model(spelling.log_p, left, words, shards), gains


def _met(blobs: DataFrame, shards: int) -> DataFrame:
    return blobs.repartition(2 * shards, "shard").sortWithinPartitions("shard", "kind")


def _by_shard(batches) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Each shard's (kind, blob) of rows that are sorted by shard."""
    shard, held = None, []
    for batch in batches:
        for s, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard and held:
                yield shard, held
                held = []
            shard = s
            held.append((kind, blob))
    if held:
        yield shard, held


def _before(w: Words, words: int) -> np.ndarray:
    """The word before each word; START before a text's first, or before all words if they have no context."""
    if words == 1:
        return np.full(len(w.name), START)
    before = np.concatenate([[START], w.name[:-1]])
    before[w.first[:-1]] = START
    return before


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards in the order of keys."""
    return ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _cuts(key: np.ndarray, shards: int) -> list[int]:
    return np.searchsorted(_shard(key, shards), np.arange(shards + 1, dtype=np.uint64)).tolist()


def _grouped(key: np.ndarray, shards: int, per_key: list[np.ndarray], each: list[np.ndarray], kind: int) -> list[tuple[int, int, bytes]]:
    """Blobs by shard of the different keys, how many entries each has, ``per_key`` arrays and ``each`` entry's; ``key`` is sorted."""
    new = _starts(key)
    known, ends = key[new], np.append(new, len(key))
    cut = _cuts(known, shards)
    out = []
    for s in range(shards):
        i, j = cut[s], cut[s + 1]
        if j > i:
            x, y = ends[i], ends[j]
            out.append((s, kind, _pack(np.diff(known[i:j], prepend=np.uint64(0)), np.diff(ends[i : j + 1]), *[p[i:j] for p in per_key], *[e[x:y] for e in each])))
    return out


def _counted_pairs(texts: DataFrame, held: Broadcast, words: int, shards: int) -> DataFrame:
    """Blobs of a task's pairs by the second word: how often each was seen, and how the second word is spelled."""

    def run(batches):
        model = held.value
        some, spelt, size = [], [], 0

        def flushed():
            a, b = (np.concatenate([x[i] for x in some]) for i in range(2))
            name, log = (np.concatenate([x[i] for x in spelt]) for i in range(2))
            _, at, n = np.unique(paired(a, b), return_index=True, return_counts=True)
            order = np.argsort(b[at])
            at, n = at[order], n[order]
            return _blobs(_grouped(b[at], shards, [log[np.unique(name, return_index=True)[1]].astype(np.float32)], [a[at], n], 0))

        for batch in batches:
            for _, part in chunks_of([t or "" for t in batch.column(0).to_pylist()]):
                w = read(part)
                some.append((_before(w, words), w.name))
                spelt.append(model.spellings(w)[:2])
                size += len(w.name)
                if size > HELD // 2:
                    yield flushed()
                    some, spelt, size = [], [], 0
        if size:
            yield flushed()
        trim()

    return texts.mapInArrow(run, _BLOBS)


def _of_counts(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4)]


def _merged(blobs: DataFrame, words: int) -> DataFrame:
    """All pairs with their counts, by the second word, and what the discounts are made of."""

    def run(batches):
        for shard, held in _by_shard(batches):
            parts = [_unpack(blob, "u8", "i8", "f4", "u8", "i8") for _, blob in held]
            b = np.concatenate([np.repeat(np.cumsum(p[0], dtype=np.uint64), p[1]) for p in parts])
            a, n = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
            name, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_index=True)
            spelt = np.concatenate([p[2] for p in parts])[at]
            del parts, held
            key = paired(a, b)
            order = np.argsort(key)
            new = _starts(key[order])
            n, at = np.add.reduceat(n[order], new), order[new]
            order = np.argsort(b[at])
            a, b, n = a[at][order], b[at][order], n[order]
            first = np.append(_starts(b), len(b))
            count = np.diff(first) if words > 1 else np.add.reduceat(n, first[:-1])
            stats = [*_of_counts(n), *_of_counts(count), len(name), int(count.sum())]
            i = 0
            while i < len(name):  # in pieces of about HELD pairs
                j = max(i + 1, int(np.searchsorted(first, first[i] + HELD, side="right")) - 1)
                x, y = first[i], first[j]
                blob = _pack(np.diff(name[i:j], prepend=np.uint64(0)), np.diff(first[i : j + 1]), spelt[i:j], a[x:y], n[x:y])
                row = {"shard": [shard], "kind": [0], "blob": [blob], **{c: [v] for c, v in zip(_STATS, stats, strict=True)}}
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary()), *[(c, pa.int64()) for c in _STATS]]))
                i, stats = j, [0] * len(_STATS)
        trim()

    return blobs.mapInArrow(run, _BLOBS + "".join(f", {c} long" for c in _STATS))


def _off(n: np.ndarray, off: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *off])[np.minimum(n, 3)]


def _followed(pairs: DataFrame, words: int, shards: int, off: tuple[float, float, float], total: int, left: float) -> DataFrame:
    """Blobs of words' gains (kind 0), and of pairs by the first word (kind 1) with their counts and the second word's log probability."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                name, many, spelt, a, n = _unpack(blob, "u8", "i8", "f4", "u8", "i8")
                name = np.cumsum(name, dtype=np.uint64)
                count = many if words > 1 else n
                low = left + spelt.astype(np.float64)
                log_p = np.logaddexp(np.log((count - _off(count, off)) / total), low)
                out = _grouped(name, shards, [(log_p - low).astype(np.float32)], [], 0)
                if words > 1:
                    key = paired(a, np.repeat(name, many))
                    order = np.argsort(a)
                    out += _grouped(a[order], shards, [], [key[order], n[order], np.repeat(log_p, many)[order].astype(np.float32)], 1)
                yield _blobs(out)
        trim()

    return pairs.select("blob").mapInArrow(run, _BLOBS)


def _gains(blobs: DataFrame, off: tuple[float, float, float], shards: int) -> DataFrame:
    """Every n-gram's gain, in shards by its key. A word may have two gains, whose sum counts."""

    def run(batches):
        for _, held in _by_shard(batches):
            keys, gains, parts = [], [], []
            for kind, blob in held:
                if kind == 0:
                    name, _, gain = _unpack(blob, "u8", "i8", "f4")
                    keys.append(np.cumsum(name, dtype=np.uint64))
                    gains.append(gain)
                else:
                    parts.append(_unpack(blob, "u8", "i8", "u8", "i8", "f4"))
            if parts:
                a = np.concatenate([np.repeat(np.cumsum(p[0], dtype=np.uint64), p[1]) for p in parts])
                key, n, log_p = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
                order = np.argsort(a)
                a, key, n, log_p = a[order], key[order], n[order], log_p[order].astype(np.float64)
                new = _starts(a)
                less = _off(n, off)
                free = np.add.reduceat(less, new)
                keys += [a[new], key]
                gains += [np.log(free / np.add.reduceat(n, new)), np.logaddexp(0.0, np.log(n - less) - np.repeat(np.log(free), np.diff(np.append(new, len(a)))) - log_p)]
            key, gain = np.concatenate(keys), np.concatenate([g.astype(np.float32) for g in gains])
            order = np.argsort(key)
            key, gain = key[order], gain[order]
            cut = _cuts(key, shards)
            yield _blobs([(s, 0, _pack(np.diff(key[cut[s] : cut[s + 1]], prepend=np.uint64(0)), gain[cut[s] : cut[s + 1]])) for s in range(shards) if cut[s + 1] > cut[s]])
        trim()

    return blobs.mapInArrow(run, _BLOBS)


def sent(spark: SparkSession, model: Model) -> Broadcast:
    return spark.sparkContext.broadcast(model)  # 48**4 floats, whatever the corpus


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in few bytes: bytes of equal weight side by side, compressed."""
    parts = [np.array([len(arrays), *[len(a) for a in arrays]], np.int64).tobytes()]
    parts += [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """What _pack was given, with the kinds of number it had."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 8 * (len(kinds) + 1)
    out = []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds), 8).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n))
        at += n * size
    return out


#: The least number of shards, and how many words and pairs a shard has at most, nearly; while they are counted, how many as they are read.
SHARDS, SHARD_WORDS, SHARD_PAIRS = 48, 1 << 22, 1 << 20
#: What texts ask for is sent in so many rounds, each for some of the shards: it is several times the texts.
ROUNDS = 4
_BLOBS = "shard int, kind int, blob binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["shard", "kind", "blob"])


def _asked(texts: DataFrame, held: Broadcast, turn: int) -> DataFrame:
    """Blobs of kind 1: the n-grams of a task's texts in one shard of a round, with the texts that have them.

    ``texts`` has hash, size and text; texts alike are asked for once. One of a task's blobs has all of its texts, in the first round with what the spellings alone give.
    """

    def run(batches):
        model = held.value
        shards = model.shards
        keys: dict[tuple[int, int], int] = {}
        base, n_symbols = [], []
        grams, docs, size = [], [], 0

        def flushed():
            hashes, sizes = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
            key, doc = np.concatenate(grams), np.concatenate(docs)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            once = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(once, len(key)))
            key, doc = key[once], doc[once]
            cut = _cuts(key, shards)
            home, out = int(hashes[0]) % (shards // ROUNDS) * ROUNDS + turn, []
            for s in range(turn, shards, ROUNDS):
                a, b = cut[s], cut[s + 1]
                asks = np.full(len(hashes), s == home)
                asks[doc[a:b]] = True
                here = np.flatnonzero(asks)
                if not len(here):
                    continue
                new = _starts(key[a:b])
                told = (np.array(base, np.float64), np.array(n_symbols, np.int64)) if s == home else (np.zeros(0), np.zeros(0, np.int64))
                out.append((s, 1, _pack(
                    hashes[here], sizes[here], *told, np.diff(key[a:b][new], prepend=np.uint64(0)),
                    np.diff(np.append(new, b - a)).astype(np.uint32), (np.cumsum(asks) - 1)[doc[a:b]].astype(np.uint32), n[a:b].astype(np.uint32),
                )))
            keys.clear()
            base.clear()
            n_symbols.clear()
            return _blobs(out)

        for batch in batches:
            seen = []
            for h, size_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, size_) not in keys:
                    keys[h, size_] = len(keys)
                    base.append(0.0)
                    n_symbols.append(0)
                    seen.append((len(base) - 1, text))
            for numbers, some in chunks_of([t for _, t in seen]):
                w = read(some)
                of = np.array([seen[k][0] for k in numbers], np.int32)
                if turn == 0:
                    _, log, at = model.spellings(w)
                    own = model.left + log[at]
                    for d, x, m in zip(of.tolist(), np.add.reduceat(own, w.first[:-1]).tolist(), np.add.reduceat(w.end - w.begin, w.first[:-1]).tolist(), strict=True):
                        base[d] -= x
                        n_symbols[d] += m
                doc = of[w.text]
                every = [(w.name, doc)]
                if model.words > 1:
                    every += [(np.full(len(of), START), of), (paired(_before(w, model.words), w.name), doc)]
                for key, doc in every:
                    mine = _shard(key, shards) % np.uint64(ROUNDS) == np.uint64(turn)
                    grams.append(key[mine])
                    docs.append(doc[mine])
                    size += len(grams[-1])
            if max(size, 8 * len(keys)) > HELD:  # short texts ask for little, but are held too
                yield flushed()
                grams, docs, size = [], [], 0
        if keys:
            yield flushed()
        trim()

    return texts.mapInArrow(run, _BLOBS)


def _answered(blobs: DataFrame) -> DataFrame:
    """(hash, size, nll, n_symbols, asked): parts of each text's sum of -log p, of its symbols' number, and how often it was asked for.

    A shard's gains come first and are held; what is asked of it streams by.
    """

    def run(batches):
        shard, known, key, gain = None, [], np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            for s, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, known, key, gain = s, [], np.zeros(0, np.uint64), np.zeros(0)
                if kind == 0:
                    grams, own = _unpack(blob, "u8", "f4")
                    known.append((np.cumsum(grams, dtype=np.uint64), own))
                    continue
                if known:
                    key, gain = (np.concatenate([k[i] for k in known]) for i in (0, 1))
                    order = np.argsort(key)
                    new = _starts(key[order])
                    key, gain, known = key[order][new], np.add.reduceat(gain[order], new), []
                hashes, sizes, base, n_symbols, grams, docs, doc, n = _unpack(blob, "i8", "i8", "f8", "i8", "u8", "u4", "u4", "u4")
                grams = np.cumsum(grams, dtype=np.uint64)
                at = np.minimum(np.searchsorted(key, grams), max(len(key) - 1, 0))
                own = np.where(key[at] == grams, gain[at], 0.0) if len(key) else np.zeros(len(grams))
                part = -np.bincount(doc, np.repeat(own, docs) * n, minlength=len(hashes))
                none = np.zeros(len(part), np.int64)
                part, m, asked = (part + base, n_symbols, none + 1) if len(base) else (part, none, none)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes, sizes, part, m, asked)], names=["hash", "size", "nll", "n_symbols", "asked"])
        trim()

    return blobs.mapInArrow(run, "hash long, size long, nll double, n_symbols long, asked long")


def _key(text: Column) -> Column:
    """What texts alike have in common: a 64-bit hash and the number of bytes."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).cast("long").alias("size"))


def scores(texts: DataFrame, model: Broadcast, gains: DataFrame) -> DataFrame:
    """(key, nll, n_symbols) of every different text: its mean -log p of a symbol. ``texts`` has one column, text.

    The n-grams that texts ask for meet their gains shard by shard; each gives every text one number, and those are summed.
    Copies of a text may be asked for in several tasks, and not equally often in every round, so a round's sums are divided
    by that number.
    """
    ship(texts.sparkSession)
    per_round = model.value.shards // ROUNDS
    asked = texts.select(F.coalesce("text", F.lit("")).alias("text")).select(_key(F.col("text")).alias("key"), "text").select("key.hash", "key.size", "text")
    rounds = []
    for turn in range(ROUNDS):
        mine = gains.where(F.col("shard") % ROUNDS == turn)
        parts = _answered(_met(mine.unionByName(_asked(asked, model, turn)), per_round))
        rounds.append(staged(parts.groupBy("hash", "size").agg(*[(F.sum(c) / F.sum("asked")).alias(c) for c in ("nll", "n_symbols")])))
    parts = rounds[0]
    for more in rounds[1:]:
        parts = parts.unionByName(more)
    whole = parts.groupBy("hash", "size").agg(F.sum("nll").alias("nll"), F.sum("n_symbols").alias("n_symbols"))
    out = staged(whole.select(F.struct("hash", "size").alias("key"), (F.col("nll") / F.col("n_symbols")).alias("nll"), F.col("n_symbols").cast("long").alias("n_symbols")))
    release(*rounds)
    return out


#: Bits of the filter that spares rows a shuffle: 4 MB whatever the table; where it fills up, more rows are shuffled.
FILTER_BITS = 1 << 25


def _maybe(large: DataFrame, on: Column, small: DataFrame, by: Column) -> DataFrame:
    """``large`` with _maybe: false only where no row of ``small`` has the key."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = small.select(place(by).alias("p")).select(F.shiftright("p", 6).alias("_w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy("_w").agg(F.bit_or("b").alias("_b"))
    met = large.withColumn("_p", place(on)).join(F.broadcast(bits), F.shiftright("_p", 6) == F.col("_w"), "left")
    flag = F.coalesce(F.expr("(shiftrightunsigned(_b, CAST(_p & 63 AS INT)) & 1L) = 1L"), F.lit(False))
    return met.withColumn("_maybe", flag).drop("_p", "_w", "_b")


def _judged(rows: DataFrame, labels: DataFrame, quantile: float, slack: float) -> tuple[DataFrame, DataFrame]:
    """(id, lang, key) of every row, and (of, key, nll, bound, kept) of every different text in a language. ``rows`` has id, text and lang."""
    named = staged(rows.select("id", "lang", _key(F.col("text")).alias("key")))
    # Labels grow with the corpus, so they are never broadcast; a filter of fixed size spares most other texts the shuffle.
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id")).distinct().hint("merge")
    set_aside = lambda c: F.pmod(c, F.lit(HELD_OUT)) == 0
    trusted = staged(hot_join(named.where("id IS NOT NULL"), good, "id", "left_semi").select("lang", "key"))
    n_aside, n = trusted.agg(F.count_if(set_aside(F.col("key.hash"))), F.count(F.lit(1))).first()
    split = 0 < n_aside < n
    texts = rows.select("id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(~set_aside(F.xxhash64("text"))) if split else texts
    near = _maybe(texts, F.col("id"), good, F.col("id")).where("_maybe").drop("_maybe")
    fitted, gains = train(hot_join(near, good, "id", "left_semi"), F.col("text"), WORDS)
    whole = scores(rows.select("text"), sent(rows.sparkSession, fitted), gains)
    release(gains)
    aside = trusted.where(set_aside(F.col("key.hash"))) if split else trusted
    known = hot_join(aside, whole, "key")
    middle = lambda g: g.agg(F.percentile_approx("nll", F.array(F.lit(0.5), F.lit(quantile)), 10_000).alias("q"), F.count(F.lit(1)).alias("n"))
    q = middle(known).first().q
    half, high = (q[0], q[0] + slack * (q[1] - q[0])) if q else (0.0, float("inf"))
    # Of fewer texts than that the quantile is the greatest, which many a good one exceeds.
    own, few = F.col("q")[0] + slack * (F.col("q")[1] - F.col("q")[0]), F.col("n") * (1 - quantile) < 1
    bounds = middle(known.groupBy("lang")).select(F.col("lang").alias("of"), F.col("q")[0].alias("median"), F.when(few, F.greatest(own, F.lit(high))).otherwise(own).alias("high"))
    # One row for each language: broadcast while there are LANGUAGES at most, so that a common language's rows stay
    # where they are; a table with more of them has none that holds much, and is joined by shuffle.
    bounds = staged(bounds)
    bounds = F.broadcast(bounds) if bounds.count() <= LANGUAGES else bounds
    found = whole.join(named.select("lang", "key").distinct(), "key").join(bounds, F.col("lang") == F.col("of"), "left")
    median, bound = F.coalesce("median", F.lit(half)), F.coalesce("high", F.lit(high))
    blended = (F.col("nll") * F.col("n_symbols") + median * PRIOR) / (F.col("n_symbols") + PRIOR)
    verdicts = staged(found.select(F.struct("key", "lang").alias("what"), "nll", bound.alias("bound"), (blended <= bound).alias("kept")))
    release(trusted, whole)
    return named, verdicts


def _plain(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"))


def judge(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = QUANTILE, slack: float = SLACK, keep: list[str] | None = None,
) -> DataFrame:
    """Each row as struct ``_row`` with nll, perplexity, the bound of its language, and kept.

    Trusted are the documents whose label ``quality`` is 1; a quarter of them, by a hash of the text, is held out of the
    counts (where that leaves none, all serve for both). The bound lies ``slack`` times as far above the held-out median
    as the held-out quantile does, so it is the quantile by default; a language with too few held-out texts to tell it takes the
    bound of all, if that is higher. A document's mean is first blended with PRIOR symbols at the median.

    Null and empty texts consist of the closing word; null languages are a language of their own; repeated
    rows and labels change nothing but the counts; columns may have any names; very long texts are read in parts; with no labels every
    row is kept; an empty table gives none.
    """
    cols = docs.columns if keep is None else keep
    plain = _plain(docs, id_col, text_col, lang_col)
    named, verdicts = _judged(plain, labels, quantile, slack)
    release(named)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.struct(_key(F.col(f"`{text_col}`")).alias("key"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang")).alias("what"))
    return hot_join(rows, verdicts, "what").select("_row", "nll", F.exp("nll").alias("perplexity"), F.exp("bound").alias("bound"), "kept")


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that judge() keeps, in its columns. Only rows that a filter of the rejected texts holds are shuffled."""
    named, verdicts = _judged(_plain(docs, id_col, text_col, lang_col), labels, QUANTILE, SLACK)
    release(named)
    bad = verdicts.where("NOT kept").select("what")
    what = F.struct(_key(F.col(f"`{text_col}`")).alias("key"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"))
    rows = _maybe(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), what.alias("what")), F.col("what"), bad, F.col("what"))
    kept = rows.where("NOT _maybe").select("_row").unionByName(hot_join(rows.where("_maybe").drop("_maybe"), bad, "what", "left_anti").select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge(docs, table(spark, sf_dir, "labels"), keep=["doc_id", "lang"]).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_row.lang").alias("lang"), "perplexity", "bound", "kept"
    )

"""The model against Kneser-Ney by dictionaries, and what the query keeps of labelled documents."""

import functools
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import language_model as lm

SF = "/root/testdata/sf0.01"
ALPHABET = lm.alphabet()


def split(text):
    """Words, a repeated one as None, and the closing one as ''."""
    words = re.findall(r"\S+", text)
    return [None if i and w == words[i - 1] else w for i, w in enumerate(words)] + [""]


def spelling(word):
    if word is None:
        return [lm.REPEAT]
    return [int(ALPHABET[min(ord(c), 0xFFFF)]) for c in word] + [lm.SPACE]


def direct(texts):
    """p(symbols of a 4-gram's last place | three before) by the textbook's recursion, over tuples of symbols."""
    counts = {4: Counter()}
    for t in texts:
        for w in split(t):
            s = [0, 0, 0, *spelling(w)]
            counts[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5) if n[1] and n[2] else (0.5, 0.75, 0.9)
        discount[k] = [min(max(d, 0.05), m) for d, m in zip(raw, (0.95, 1.9, 2.9), strict=True)] if n[1] and n[2] else raw
    after = {k: defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]][g[-1]] = n

    @functools.cache
    def p(context, symbol):
        k = len(context) + 1
        lower = p(context[1:], symbol) if context else 1 / lm.SYMBOLS
        seen = after[k].get(context)
        if not seen:
            return lower
        off = lambda n: discount[k][min(n, 3) - 1]
        total = sum(seen.values())
        own = seen[symbol] - off(seen[symbol]) if symbol in seen else 0
        return own / total + sum(map(off, seen.values())) / total * lower

    return p


def by_hand(texts, trusted):
    """(mean -log p of a symbol, symbols) of each text, word by word over dictionaries."""
    p, counts = direct(trusted), Counter(w for t in trusted for w in split(t))
    n = Counter(counts.values())
    y = n[1] / (n[1] + 2 * n[2])
    raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
    d = [min(max(x, 0.05), m) for x, m in zip(raw, (0.95, 1.9, 2.9), strict=True)]
    every = sum(counts.values())
    left = sum(d[min(c, 3) - 1] for c in counts.values()) / every
    out = []
    for t in texts:
        total, size = 0.0, 0
        for w in split(t):
            s, log = [0, 0, 0, *spelling(w)], 0.0
            for i in range(3, len(s)):
                log += math.log(p(tuple(s[i - 3 : i]), s[i]))
            own = (counts[w] - d[min(counts[w], 3) - 1]) / every if w in counts else 0.0
            total -= math.log(own + left * math.exp(log)) if log > -600 else (math.log(own) if own else math.log(left) + log)
            size += len(s) - 3
        out.append((total / size, size))
    return out


ODD = ["a a a b", "", "   ", "\n\n", "x" * 3000, "новое слово 一二 三", "a\u3000b\tc", "\x00 \x1f"]


def test_probabilities_against_the_direct_recursion(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()] + ["a a a b", ""]
    (model, _), p, rng, n = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text")), direct(texts), random.Random(1), lm.SYMBOLS
    for _ in range(300):
        context = tuple(rng.randrange(n) if rng.random() < 0.3 else s for s in rng.choice([(0, 0, 0), (20, 8, 5), (0, 8, 5), (9, 14, 7), (0, 0, 20)]))
        code = ((context[0] * n + context[1]) * n + context[2]) * n
        mine = [math.exp(x) for x in model.log_p[code : code + n]]
        assert abs(sum(mine) - 1) < 1e-4
        symbol = rng.randrange(n)
        assert abs(mine[symbol] - p(context, symbol)) < 1e-5


def scored(spark, texts, trusted, repeat=1):
    model, shares = lm.train(spark.createDataFrame([(t,) for t in trusted], "text string"), F.col("text"))
    asked = spark.createDataFrame([(t,) for t in texts] * repeat, "text string").repartition(5)
    got = lm.scores(asked, lm.sent(spark, model), shares)
    keyed = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", lm._key(F.col("text")).alias("key"))
    return [(r.nll, r.n_symbols) for r in keyed.join(got, "key").orderBy("i").collect()]


def test_scores_against_words_by_hand(spark, monkeypatch):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(16).collect()]
    texts, trusted = list(dict.fromkeys(rows[6:] + ODD)), rows[:11]
    for mine, theirs in zip(scored(spark, texts, trusted), by_hand(texts, trusted), strict=True):
        assert abs(mine[0] - theirs[0]) < 1e-4 and mine[1] == theirs[1]
    # Texts that several tasks ask for, and many small blobs, change nothing.
    monkeypatch.setattr(lm, "HELD", 500)
    once, often = by_hand(texts, trusted), scored(spark, texts, trusted, 7)
    assert len(once) == len(often) and all(abs(a[0] - b[0]) < 1e-4 for a, b in zip(once, often, strict=True))


def test_word_counts_grow_with_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few, all_ = (lm.counted(d, F.col("text")).where("kind = 1") for d in (docs.where("doc_id % 10 = 0"), docs))
    assert all_.count() > 3 * few.count()
    words = Counter(w for r in docs.collect() for w in split(r.text or ""))
    assert sorted(words.values()) == sorted(r.n for r in all_.collect())


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    text = "some plain words of a text that is read in parts because it is long " * 50
    whole = scored(spark, [text, "x", ""], [text])
    monkeypatch.setattr(lm, "CHUNK", 100)
    parts = scored(spark, [text, "x", ""], [text])
    assert abs(whole[0][0] - parts[0][0]) < 0.2


def test_only_rejected_rows_are_missing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.withColumn("_maybe", F.lit(1)).withColumn("what", F.lit(2))
    judged = lm.judge(docs, labels)
    assert judged.count() == docs.count()
    kept = sorted(r[0] for r in judged.where("kept").select("_row.doc_id").collect())
    got = lm.accepted(odd, labels)
    assert got.columns == odd.columns and sorted(r.doc_id for r in got.collect()) == kept


def test_junk_goes_and_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = lm.judge(docs, labels).select("_row.doc_id", "kept").join(labels.select("doc_id", "quality"), "doc_id").collect()
    rejected = {q: [not r.kept for r in got if r.quality == q] for q in (0, 1)}
    assert sum(rejected[0]) / len(rejected[0]) >= 0.9 and sum(rejected[1]) / len(rejected[1]) <= 0.01


def pairs_by_hand(texts, trusted):
    """(mean -log p of a symbol, symbols) of each text under pairs of words, by the textbook's recursion over dictionaries."""
    p, pairs = direct(trusted), Counter()
    for t in trusted:
        words = split(t)
        pairs.update(zip(["START", *words[:-1]], words, strict=True))
    follows, before = defaultdict(dict), Counter(b for _, b in pairs)
    for (a, b), n in pairs.items():
        follows[a][b] = n

    def discounts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        d = [min(max(x, 0.05), m) for x, m in zip(raw, (0.95, 1.9, 2.9), strict=True)]
        return lambda c: d[min(c, 3) - 1]

    off, low = discounts(pairs.values()), discounts(before.values())
    left = sum(map(low, before.values())) / len(pairs)

    def log_p(a, b):
        s, spelt = [0, 0, 0, *spelling(b)], 0.0
        for i in range(3, len(s)):
            spelt += math.log(p(tuple(s[i - 3 : i]), s[i]))
        share = (before[b] - low(before[b])) / len(pairs) if b in before else 0.0
        word = math.log(share + left * math.exp(spelt)) if share else math.log(left) + spelt
        seen = follows.get(a)
        if not seen:
            return word
        weight = math.log(sum(map(off, seen.values())) / sum(seen.values()))
        return math.log((seen[b] - off(seen[b])) / sum(seen.values()) + math.exp(weight + word)) if b in seen else weight + word

    out = []
    for t in texts:
        words = split(t)
        size = sum(len(spelling(w)) for w in words)
        out.append((-sum(log_p(a, b) for a, b in zip(["START", *words[:-1]], words, strict=True)) / size, size))
    return out


def paired(spark, texts, trusted, repeat=1):
    model, gains = lm.train(spark.createDataFrame([(t,) for t in trusted], "text string"), F.col("text"), 2)
    got = lm.scores(spark.createDataFrame([(t,) for t in texts] * repeat, "text string").repartition(5), lm.sent(spark, model), gains)
    keyed = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", lm._key(F.col("text")).alias("key"))
    return [(r.nll, r.n_symbols) for r in keyed.join(got, "key").orderBy("i").collect()]


def test_pairs_of_words_against_the_direct_recursion(spark, monkeypatch):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(16).collect()]
    texts, trusted = list(dict.fromkeys(rows[6:] + ODD)), rows[:11]
    theirs = pairs_by_hand(texts, trusted)
    for mine, direct_ in zip(paired(spark, texts, trusted), theirs, strict=True):
        assert abs(mine[0] - direct_[0]) < 1e-4 and mine[1] == direct_[1]
    # Small blobs and pieces, texts that are asked for several times and differently often in the rounds.
    monkeypatch.setattr(lm, "HELD", 500)
    often = paired(spark, texts, trusted, 7)
    assert len(often) == len(theirs) and all(abs(a[0] - b[0]) < 1e-4 and a[1] == b[1] for a, b in zip(often, theirs, strict=True))


def test_shuffled_words_are_less_probable(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    long = docs.join(labels.where("quality = 1"), "doc_id").where("size(split(text, ' ')) >= 100").select("doc_id", "lang", "text")
    mixed = long.select((F.col("doc_id") + 10**9).alias("doc_id"), "lang", F.array_join(F.shuffle(F.split("text", r"\s+"), F.lit(1)), " ").alias("text"))
    every = docs.select("doc_id", "lang", "text").unionByName(mixed)
    nll = {r.doc_id: r.nll for r in lm.judge(every, labels).select("_row.doc_id", "nll").collect()}
    both = [(nll[d - 10**9], n) for d, n in nll.items() if d >= 10**9]
    assert len(both) > 50 and sum(a < b for a, b in both) / len(both) > 0.95


def test_order_of_words_decides_where_it_tells(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abdegilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    after = {w: rng.sample(words, 4) for w in words}

    def text():
        out = [rng.choice(words)]
        while len(out) < 80:
            out.append(rng.choice(after[out[-1]]))
        return out

    prose = [text() for _ in range(700)]
    mixed = [rng.sample(t, len(t)) for t in prose[600:]]
    docs = spark.createDataFrame([(i, " ".join(t), "xx") for i, t in enumerate(prose + mixed)], "doc_id long, text string, lang string")
    labels = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    kept = {r.doc_id for r in lm.judge(docs, labels).where("kept").select("_row.doc_id").collect()}
    assert len([i for i in range(600, 700) if i in kept]) >= 95 and not [i for i in range(700, 800) if i in kept]

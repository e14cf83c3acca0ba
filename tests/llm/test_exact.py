"""Operators against brute force on small inputs, and the queries of the contract on the test tables."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html_text, near_dedup, substring_tree, toxicity
from tessera.llm.common import components
from tessera.llm.paragraph_dedup import paragraphs_of, repeats

SF = "/root/testdata/sf0.001"


def brute_removals(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out


def test_repeated_strings_against_brute_force(spark):
    rng = random.Random(5)
    passages = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (199, 200, 201, 260, 420)]
    texts = []
    for _ in range(60):
        parts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(0, 150)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(0, 150)))]
        texts.append(b"".join(parts))
    texts += [b"ab" * 300, b"x" * 199, b"y" * 200, b"y" * 200]
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    want = brute_removals(texts)
    for group in (65_536, 2):
        got = {r.id: r for r in substring_tree.digest(docs, group=group).collect()}
        for k, kept in enumerate(want):
            assert got[k].kept_sha256 == hashlib.sha256(kept).hexdigest(), (group, k)


def test_anchors_of_a_long_text_in_chunks():
    rng = random.Random(9)
    for n in (0, 199, 200, 700, 1000, 1239, 5000):
        raw = bytes(rng.choice(b"ab ") for _ in range(n))
        assert substring_tree.anchors_of(raw, 300).tolist() == substring_tree.anchors_of(raw).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", min_size=2, max_size=6)), min_size=2, max_size=8), st.integers(3, 8))
def test_interval_tree_finds_the_longest_extensions(pairs, length):
    pairs = sorted(set(pairs))
    left, right = [p[0].encode() for p in pairs], [p[1].encode() for p in pairs]
    got = substring_tree.repeats(left, right, [1] * len(pairs), length)
    for i in range(len(pairs)):
        best = [0, 0]
        for j in range(len(pairs)):
            a, b = substring_tree._common(left[i], left[j]), substring_tree._common(right[i], right[j])
            if i != j and a + b >= length:
                best = [max(best[0], a), max(best[1], b)]
        # Nodes of the tree above the pair's own may reach as far left with less to the right, never further.
        assert got[i] == tuple(best)


def test_near_duplicate_classes_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {k: near_dedup.counted_shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and (texts[a] == texts[b] or (held[a] and held[b] and near_dedup.similarity(held[a], held[b]) >= 0.8)):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == {k: root(k) for k in texts}


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    for shared in (0.5, 0.8):
        n = int(400 * 2 * shared / (1 + shared))
        y = np.concatenate([x[:n], rng.integers(1, 1 << 60, 400 - n).astype(np.uint64)])
        agree = (near_dedup.signature(x, k=2000) == near_dedup.signature(y, k=2000)).mean()
        assert abs(agree - shared) < 0.05
    weights = np.full(400, 1.5)
    assert abs((near_dedup.signature(x, np.ones(400), 2000) == near_dedup.signature(x, weights, 2000)).mean() - 1 / 1.5) < 0.05


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3)] + [(100, k) for k in range(101, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4} | {k: 100 for k in range(100, 140)}


def test_paragraphs_of_a_passage_stay_the_same():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(4000)]
    found = 0
    for _ in range(100):
        passage = " ".join(rng.sample(words, 55))
        a, b = (" ".join(rng.sample(words, 60)) + " " + passage + " " + " ".join(rng.sample(words, 60)) for _ in range(2))
        found += bool(set(paragraphs_of([a])[1]) & set(paragraphs_of([b])[1]))
    assert found >= 95
    texts = [" ".join(rng.sample(words, n)) for n in (500, 0, 7, 8, 30)]
    together, apart = paragraphs_of(texts), [paragraphs_of([t]) for t in texts]
    assert together[1].tolist() == [x for p in apart for x in p[1].tolist()] and set(together[0].tolist()) == {0, 3, 4}
    for text, start, end in zip(*(together[k].tolist() for k in (0, 2, 3)), strict=True):
        assert f" {texts[text]} ".find(f" {texts[text][start:end]} ") == start and len(texts[text][start:end].split()) > 7


def sets_of(text):
    """(name, start, end, shingles as words) of each paragraph: only where paragraphs are cut is taken from the operator."""
    _, name, start, end, *_ = paragraphs_of([text])
    for n, a, b in zip(name.tolist(), start.tolist(), end.tolist(), strict=True):
        w = text[a:b].lower().split()
        yield n, a, b, frozenset(zip(*(w[i:] for i in range(5)), strict=False))


def test_paragraph_classes_against_brute_force(spark):
    rng = random.Random(7)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    # Copies with a word changed here and there, so that near paragraphs abound.
    for k, (_, text) in enumerate(docs[:60]):
        w = text.split()
        for at in range(0, len(w), 40):
            w[at + rng.randrange(min(40, len(w) - at))] = f"other{k}"
        docs.append((1000 + k, " ".join(w)))
    held = [(i, a, b, s) for i, t in docs for _, a, b, s in sets_of(t or "")]
    parent = list(range(len(held)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by_shingle = {}
    for k, (*_, s) in enumerate(held):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    seen, near = set(), 0
    for group in by_shingle.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    x, y = held[i][3], held[j][3]
                    if len(x & y) / len(x | y) >= 0.8:
                        near += x != y
                        parent[root(j)] = root(i)
    size = Counter(root(k) for k in range(len(held)))
    want = {(i, a, b, size[root(k)]) for k, (i, a, b, _) in enumerate(held) if size[root(k)] > 1}
    got = repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert near > 20 and {(r.id, r.start, r.end, r.n_copies) for r in got} == want and len(got) == len(want)
    one = Counter(r.class_id for r in got if not r.removed)
    assert set(one.values()) == {1} and set(one) == {r.class_id for r in got}


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Head</header><nav><ul><li>Menu</ul></nav>
<div class="sidebar">Side</div><article><h1>One &amp; two</h1><p>First <b>bold<br>line<p>Second  line</p><div class="comments">No</div></article>
<form>Ask</form><footer>&copy; Foot</footer>"""


def test_page_text():
    assert html_text.main_text(html_text.parse(PAGE), set()) == "One & two\n\nFirst bold line\n\nSecond line"


def test_template_of_a_site_is_cut(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [(k, f"http://x.y/{k}", f"<body><div class=top>Same line everywhere</div><div class=own>{words[k % 7]} {k} own text</div></body>") for k in range(30)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["_row"]["page_id"]: r.text for r in out} == {k: f"{words[k % 7]} {k} own text" for k in range(30)}


def test_toxicity_held_out():
    rng = random.Random(3)
    plain = ["".join(rng.choice(["er", "on", "th", "an", "re", "ti"]) for _ in range(3)) for _ in range(900)]
    made = []
    for k in range(1200):
        w = [rng.choice(plain) for _ in range(120)]
        toxic = k % 4 == 0
        for _ in range(6 if toxic else 0):
            w[rng.randrange(120)] = rng.choice(["vilewort", "scumbrand", "nastypox"])
        made.append((str(k), " ".join(w), int(toxic)))
    model = toxicity.train(made[:900])
    a, b = toxicity._compressor(model.ordinary), toxicity._compressor(model.toxic)
    s = model.score(np.array([toxicity.figures_of(t, a, b) for _, t, _ in made[900:]]))
    y = np.array([y for *_, y in made[900:]])
    assert ((s >= 0.5) == (y == 1)).mean() > 0.9


def test_window_of_brute_force_words():
    from tessera.llm.decontamination import windows_of, words_of

    assert words_of("Ab-c 9É x") == ["ab".encode(), b"c", "9É x".encode()]
    assert [n for _, n in windows_of(words_of("a b c"), 10)] == [3] and len(windows_of([b"x"] * 12)) == 3 and windows_of([]) == []




def test_labelled_sample_takes_an_id_once(spark):
    docs = spark.createDataFrame([(1, "b")] * 20 + [(1, "a"), (2, "two"), (3, None), (4, "four"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 20 + [(2, 0), (2, 1), (3, 1), (4, 0), (None, 1), (1, None), (4, 7)], "doc_id long, toxic int")
    import zlib

    want = [(str(k), t, y) for k, t, y in ((4, "four", 0), (1, "a", 1)) if zlib.crc32(str(k).encode()) % 5]
    assert toxicity.labelled_sample(docs, labels) == want and want


def test_odd_pages_are_read_in_linear_time():
    import time

    odd = ["<div>x" * 60_000, "<div>" * 100_000 + "x", '<a "' * 100_000, '<a "x" ' * 60_000 + '">', "<div>" * 60_000 + "</b>" * 60_000, "<li>x" * 60_000, "<script>" * 60_000, "<!--" * 100_000, "x" * 1_000_000]
    for page in odd:
        begun = time.perf_counter()
        html_text.main_text(html_text.parse(page), {1})
        assert time.perf_counter() - begun < 5, page[:10]
    assert html_text.main_text(html_text.parse('a <b c="1>0"> d<e "> f</b> < g <3 &lt;'), set()) == 'a d<e "> f < g <3 <'


def test_article_in_a_wrapper_with_a_telling_name():
    page = '<div class="share-form"><article><h1>One</h1><p>Two</p></article></div><div class="comments">No</div>'
    assert html_text.main_text(html_text.parse(page), set()) == "One\n\nTwo"
    both = '<article><p>One</p></article><div class="comments"><article>No</article></div>'
    assert html_text.main_text(html_text.parse(both), set()) == "One"


def test_rules_are_ordered_by_rejections_per_cost(spark):
    from pyspark.sql import functions as F

    from tessera.llm import quality_rules as q

    docs = spark.createDataFrame([(k, "word " * 400 + ("x" if k % 2 else "y")) for k in range(200)], "doc_id long, text string")
    dear = F.length(F.regexp_replace(F.regexp_replace("_text", "o(?=r)", "0"), "(w)(0)", "$2$1")) > 0
    rules = [
        q.Rule("dear", lambda: dear & F.col("_text").endswith("x")), q.Rule("cheap", lambda: F.col("_text").endswith("x")), q.Rule("never", lambda: F.col("n_words") < 0),
    ]
    assert [r.name for r in q.cascade(q.features(docs), rules)] == ["cheap", "dear", "never"]

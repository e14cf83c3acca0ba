"""Operators on small inputs with hand-made or brute-force answers."""

import math
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import ids, text
from tessera.operators import agent, chunks, context, evaluation, fusion, graph, lexical, nearest, store, tracing
from tessera.plans import fixtures, retrieval
from tessera.sources import files, tables
from tessera.streaming import feeds


def col(spark, values, expr, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(expr).collect()]


def test_tokens_keep_underscores_and_drop_other_letters(spark):
    assert col(spark, ["def my_fn(x2): Été"], text.tokens(F.col("x"))) == [["def", "my_fn", "x2", "t"]]


def test_names_and_counts(spark):
    assert col(spark, ["a.b.c", "f"], text.owner(F.col("x"))) == ["a.b", None]
    assert col(spark, ["a.b.c", "f"], text.bare_name(F.col("x"))) == ["c", "f"]
    assert col(spark, ["", "abcdefgh"], text.token_count(F.col("x"))) == [1, 2]
    assert col(spark, ["a\n \n\nb"], text.without_blank_lines(F.col("x"))) == ["a\nb"]
    assert col(spark, ["loading", "tested", "is", "boxes"], text.stem(F.col("x"))) == ["load", "test", "is", "box"]
    assert col(spark, ["tests/a.py", "x\\tests\\a.py", "src/a.py"], text.is_production(F.col("x"))) == [False, False, True]
    assert col(spark, ["tests/a.py"], text.is_production(F.col("x"), anchored=False)) == [True]


def test_uuid5_equals_the_standard_library(spark):
    names = ["a", "é:1", "repo:file.py:f:10"]
    assert col(spark, names, ids.uuid5(F.col("x"))) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_bm25_finds_the_exact_identifier_and_drops_zero_scores(spark):
    docs = spark.createDataFrame([(1, "def pay_now(): charge card", "pay_now"), (2, "read file from disk", "read"), (3, "write file to disk", "write")], "id int, t string, n string")
    index = lexical.build_index(docs, F.col("id"), F.col("t"), F.col("n"))
    asked = spark.createDataFrame([("q1", "pay_now"), ("q2", "nothing here matches"), ("q3", "read")], "q string, t string")
    hits = lexical.search(index, asked, F.col("q"), F.col("t")).collect()
    assert {(h.question, h.doc) for h in hits if h["rank"] == 1} == {("q1", 1), ("q3", 2)}
    assert all(h.bm25_score > 0 for h in hits)


def test_bm25_against_the_formula(spark):
    texts = {1: "a b b c", 2: "a a d", 3: "e f", 4: "b"}
    index = lexical.build_index(spark.createDataFrame(list(texts.items()), "id int, t string"), F.col("id"), F.col("t"))
    got = {r.doc: r.bm25_score for r in lexical.search(index, spark.createDataFrame([(1, "b c b")], "q int, t string"), F.col("q"), F.col("t")).collect()}
    words = {k: t.split() for k, t in texts.items()}
    df = {w: sum(w in d for d in words.values()) for d in words.values() for w in d}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    avg = sum(map(len, words.values())) / 4
    for k, d in words.items():
        s = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in ["b", "c", "b"])
        assert (k in got) == (round(s, 9) > 0) and (k not in got or abs(got[k] - round(s, 4)) < 1e-4)


def test_fusion_sums_reciprocal_ranks(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "question int, id string, rank int")
    k = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "question int, id string, rank int")
    out = fusion.fuse(v, k).orderBy("rank").collect()
    assert [r.id for r in out] == ["b", "a", "c"]
    assert abs(out[0].score - (0.6 / 62 + 0.4 / 61)) < 1e-9
    assert fusion.fuse(v, k.limit(0)).count() == 2


def test_nearest_blocks_give_the_same_as_one(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    v = spark.createDataFrame(rows, "id int, vector array<float>")
    q = v.where("id < 9").withColumnRenamed("id", "question")
    one, many = nearest.nearest(v, q, 4).collect(), nearest.nearest(v, q, 4, block=2).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == 36


@pytest.mark.parametrize("ranks,want", [([1, 2, 4], (0.3333, 0.5833)), ([None, None], (0.0, 0.0)), ([], (0.0, 0.0)), ([1, None], (0.5, 0.5))])
def test_metrics(spark, ranks, want):
    s = evaluation.summary(spark.createDataFrame([(r,) for r in ranks], "rank int")).first()
    assert (s.recall_at_1, s.mrr) == want


def test_percentiles_of_a_tail(spark):
    rows = [("a", 100.0)] * 95 + [("a", 5000.0)] * 5
    p = evaluation.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", "g").first()
    assert (p.p50, p.p99) == (100.0, 5000.0)


def test_expansion_is_capped_and_visits_once(spark):
    edges = spark.createDataFrame([("hub", f"leaf{k:02}", 1, "x") for k in range(50)] + [("leaf00", "hub", 1, "x"), ("leaf00", "far", 1, "x")], "src string, dst string, tier int, name string")
    seeds = spark.createDataFrame([(1, "hub", 0.9, 0)], "question int, id string, score double, pos int")
    assert graph.expand(seeds, edges, depth=1, max_expanded=10).count() == 11
    # The next hop adds one row before it sees that the cap is reached.
    out = graph.expand(seeds, edges, depth=3, max_expanded=10).collect()
    assert len(out) == 12 and len({r.id for r in out}) == 12
    two = {r.id: r for r in graph.expand(seeds, edges, depth=2, max_expanded=None).collect()}
    assert two["far"].graph_distance == 2 and abs(two["far"].graph_score - 0.8) < 1e-9 and len(two) == 52


def test_store_and_difference(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, content_hash string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "id int, content_hash string")
    assert {(r.id, r.status) for r in store.snapshot_difference(old, new).collect()} == {(1, "removed"), (2, "unchanged"), (3, "changed"), (4, "added")}
    assert {tuple(r) for r in store.upsert(old, new).collect()} == {(1, "a"), (2, "b"), (3, "x"), (4, "d")}
    assert [r.id for r in store.to_embed(new, old).orderBy("id").collect()] == [3, 4]


def test_chunk_store_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "chunks")
    tables.write_chunks(spark.createDataFrame([(1, "a"), (2, "b")], "id int, repo_id string"), path)
    tables.write_chunks(spark.createDataFrame([(3, "b")], "id int, repo_id string"), path)
    assert sorted(r.id for r in tables.read_chunks(spark, path).collect()) == [1, 3]
    tables.delete_repo(spark, path, "a")
    assert tables.count_chunks(spark, path, "b") == 1 and tables.read_chunks(spark, path).count() == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=6000), max_size=8), st.integers(400, 3000))
def test_packing_never_exceeds_its_budget(texts, most):
    out = context.fit(texts, most)
    used = sum(max(1, len(t) // 4) + context.LABEL_TOKENS for _, t in out)
    assert used <= max(0, most - context.SYSTEM_TOKENS - context.USER_TOKENS)
    assert [k for k, _ in out] == sorted({k for k, _ in out}) and all(texts[k].startswith(t) for k, t in out)


def test_priority_uses_siblings_other_than_itself(spark):
    rows = [(1, "a", "C.x", ["y"], [], 0.9), (1, "b", "C.y", [], ["C.x"], 0.5), (1, "c", "z", [], [], 0.6)]
    out = {r.id: r for r in context.with_priority(spark.createDataFrame(rows, "question int, id string, name string, calls array<string>, called_by array<string>, score double")).collect()}
    assert (out["a"].sibling_score, out["b"].sibling_score, out["c"].sibling_score) == (0.5, 0.9, 0.0)
    assert (out["a"].connectivity, out["b"].connectivity) == (1, 1)


def test_explicit_symbols_prefer_the_longest(spark):
    asked = spark.createDataFrame([(1, "what does App.run do in App")], "question int, text string")
    names = spark.createDataFrame([(1, "App"), (1, "App.run"), (1, "Other")], "question int, name string")
    assert [r.name for r in context.explicit_symbols(asked, names).collect()] == ["App.run"]


@pytest.mark.parametrize("source,abstract", [("def f(self):\n    pass", True), ('def f(self):\n    """pass"""\n    return 1', False), ("def f(self):\n    raise NotImplementedError()", True), ("def f():\n    ...", True), ("class A: pass", False)])
def test_abstract_bodies(source, abstract):
    assert chunks.is_abstract(source) is abstract


def test_runtime_bodies():
    assert not chunks.is_runtime("function", "def f(x):\n    return g(x)") and chunks.is_runtime("method", "def f(x):\n    y = g(x)\n    return y")


def test_files_keep_underscored_names(spark, tmp_path):
    for name, data in [("pkg/__init__.py", b"x = 1"), ("pkg/_priv.py", b"\xff"), ("venv/a.py", b""), ("big.py", b"#" * 500_001), ("fits.py", b"#" * 500_000), ("note.txt", b"")]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.content for r in files.scan_python_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"pkg/__init__.py", "pkg/_priv.py", "fits.py"} and got["pkg/_priv.py"] == "�"


def test_sync_equals_a_rebuild(spark):
    made = chunks.chunk_python(fixtures.files(spark), "r").cache()
    new = spark.createDataFrame([("shop/basket.py", fixtures.MODULE.replace("helper(x):", "helper(x, z=1):"))], "path string, content string")
    vectors = retrieval.embedded(made.select("id", "text"), "text").select("id", "vector")
    cache = retrieval.embedded(made.select("text"), "text").select(F.md5("text").alias("text_md5"), "vector")
    answers = spark.createDataFrame([("r", 0), ("other", 0)], "repo_id string, s int").select("repo_id", F.timestamp_seconds("s").alias("written_at"))
    out = retrieval.sync(made, fixtures.files(spark), new, "r", vectors=vectors, cache=cache, answers=answers)
    whole, counts = out.chunks, out.counters
    assert [r.repo_id for r in out.answers.collect()] == ["other"] and out.fresh.count() == 1
    want = {r.id: r.vector for r in retrieval.embedded(whole.select("id", "text"), "text").collect()}
    assert {r.id: r.vector for r in out.vectors.collect()} == want
    again = chunks.chunk_python(new, "r")
    called = {r.id: tuple(r.called_by) for r in graph.invert(again).collect()}
    assert {(r.id, tuple(r.called_by)) for r in whole.collect()} == {(r.id, called.get(r.id, ())) for r in again.collect()}
    assert counts.first().changed == 1


def test_hybrid_retrieval_puts_the_named_symbol_first(spark):
    repo = retrieval.build(chunks.chunk_python(fixtures.files(spark), "r"))
    asked = spark.createDataFrame([("q", "helper")], "question string, answer string")
    rewritten = retrieval.normalise_rewrites(asked).withColumn("question_text", F.lit("helper")).cache()
    rows = retrieval.retrieve(repo, rewritten, top_k=3, expand_graph=False).collect()
    assert min(rows, key=lambda r: r.retrieval_rank).name == "helper" and len({r.id for r in rows}) == len(rows)


def test_agent_stops_when_the_evidence_is_enough(spark):
    asked = spark.createDataFrame([(1, "how does save_file work"), (2, "what is zebra_zone")], "question int, question_text string")
    ddl = "question int, id string, name string, file string, type string, raw_source string, calls array<string>, called_by array<string>, score double"
    held = spark.createDataFrame([(1, "a", "save_file", "f.py", "function", "def save_file(): pass", ["write"], [], 0.9), (2, "b", "other", "f.py", "function", "def other(): pass", ["gone"], [], 0.4)], ddl)
    found = lambda qs, n: held.join(qs.select("question"), "question", "left_semi")
    evidence, trace = agent.run(asked, found, lambda s: held.limit(0), lambda df: df.persist())
    assert {(r.question, r.hop, r.action) for r in trace.collect()} == {(1, 0, "retrieve"), (2, 0, "retrieve"), (2, 1, "expand")}
    assert evidence.count() == 2 and [agent.retrieval_size(h) for h in range(4)] == [20, 14, 8, 4]


def test_plans_over_a_repository(spark):
    repo = retrieval.build(chunks.chunk_python(fixtures.files(spark), "r"))
    nodes, edges = retrieval.symbol_graph(repo, "Basket.add")
    assert {r.name for r in nodes.where("is_entry").collect()} == {"Basket.add"} and edges.count() >= 0
    asked = fixtures.asked(spark)
    rows = retrieval.retrieve(repo, asked).collect()
    assert {r.question for r in rows} >= {"q1", "q2"} and any(r.graph_distance == 0 for r in rows)
    told = {r.question: r for r in retrieval.answers(repo, asked, lambda p: F.lit("made up")).collect()}
    assert set(told) == {"q1", "q2", "q3"} and told["q2"].answer == "made up" and told["q2"].sources[0].name == "Basket.add"
    events = list(retrieval.answer_events(spark.createDataFrame([("q", "two words", [{"name": "n"}])], "question string, answer string, sources array<struct<name:string>>")))
    assert [e for _, e, _ in events] == ["sources", "token", "token", "done"]
    rows, counts = retrieval.hybrid(repo, asked, mode="vector")
    assert counts.where("vector_hits > 0").count() >= 2 and counts.count() == 3 and rows.count() > 0
    hits, made = retrieval.baseline_search(repo, asked, lambda p: F.length(p))
    assert hits.where(F.length("raw_source") > 300).count() == 0 and made.count() == 3
    summary, worst = retrieval.evaluate(repo)
    assert summary.first().questions == 1 and worst.count() == 1


def test_last_change_of_a_key_wins(spark, tmp_path):
    merge = feeds.upsert_feed(None, str(tmp_path / "t"), at="n")
    merge(spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "id int, v string, n int").repartition(3), 0)
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t/0")).collect()} == {(1, "new"), (2, "x")}


def test_evidence_keeps_its_first_position(spark):
    ddl = "question int, id string, score double, v string"
    old = spark.createDataFrame([(1, "a", 0.9, "old"), (1, "b", 0.8, "old")], ddl)
    merged = agent.merge_evidence(old, spark.createDataFrame([(1, "b", 0.95, "new"), (1, "c", 0.99, "new")], ddl))
    assert [(r.id, r.v) for r in merged.orderBy("position").collect()] == [("a", "old"), ("b", "new"), ("c", "new")]


def test_gates_of_the_agent(spark):
    ddl = "question int, id string, name string, type string, file string, raw_source string, calls array<string>, called_by array<string>, score double, abstract boolean, runtime boolean"
    rows = [(k, *r) for k in range(1, 6) for r in [("a", "A.run", "method", "f.py", "run the zebra", ["go"], [], 0.9, False, True), ("b", "A.go", "method", "f.py", "go zebra", ["far"], ["run"], 0.5, False, True), ("c", "Base", "class", "f.py", "", ["x"], [], 0.4, True, False)]]
    evidence = spark.createDataFrame(rows, ddl)
    state = spark.createDataFrame([(k, "how does zebra run") for k in range(1, 6)], "question int, question_text string")
    done = spark.createDataFrame([(k, "A.run", 1) for k in range(1, 6)], "question int, symbol string, hop int")
    assert {r.symbol for r in agent.next_hop(state, evidence, done).collect()} == {"A.go"}
    made = [(1, "retrieve", "how is the", []), (2, "expand_graph", "A.run", []), (3, "expand_graph", "nowhere", []), (4, "answer", "", ["Zoo.far"]), (5, "answer", "", ["run"])]
    got = agent.preferred_action(spark.createDataFrame(made, "question int, action string, action_input string, required array<string>"), state, evidence, done).collect()
    assert {r.question: (r.action, r.action_input, r.gate) for r in got} == {
        1: ("expand_graph", "A.go", "bad_query"), 2: ("expand_graph", "A.go", "already_expanded"), 3: ("expand_graph", "A.go", "unresolved_symbol"),
        4: ("retrieve", "function Zoo.far", "missing_information"), 5: ("answer", "", None),
    }


def test_bounds_of_arguments():
    from tessera import settings

    assert settings.bounded("ask_top_k", 10) == 10 and settings.asked("  why ") == "why" and settings.settings().top_k == 20
    for wrong in (lambda: settings.bounded("depth", 5), lambda: settings.asked(" a ")):
        try:
            wrong()
        except ValueError:
            continue
        raise AssertionError


def test_cache_lives_from_the_write(spark):
    rows = [("k", 0), ("k", 200), ("k", 299), ("k", 300), ("k", 599), ("j", 1)]
    asked = spark.createDataFrame(rows, "key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.key, r.s): r.hit for r in tracing.with_cache_hits(asked, ["key"]).collect()}
    assert got == {("k", 0): False, ("k", 200): True, ("k", 299): True, ("k", 300): False, ("k", 599): True, ("j", 1): False}


def test_streams_equal_batches(spark, tmp_path):
    asked = spark.createDataFrame([("k", 0), ("k", 200), ("k", 300), ("j", 1)], "key string, s int").select("key", F.timestamp_seconds("s").alias("ts"))
    asked.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    q = feeds.cache_hits(stream).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.hit for r in spark.table("hits").collect()) == [False, False, False, True]
    merge = feeds.upsert_feed(asked, str(tmp_path / "table"))
    merge(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), 0)
    merge(spark.createDataFrame([(2, "c")], "id int, v string"), 1)
    merge(spark.createDataFrame([(2, "c")], "id int, v string"), 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "table/1")).collect()} == {(1, "a"), (2, "c")}

"""Whole retrieval plans: ingest, sync, hybrid retrieval, answers, symbol graphs, evaluation.

Everything takes a frame of questions and returns frames keyed by question. Models are callables: an embedder
turns a text column into vectors, a scorer rates (question, text) pairs, a generator answers prompts. Without
weights here, the defaults are deterministic stand-ins that exercise the plan, not a model's quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators import chunks as chunking
from tessera.operators import agent, context, evaluation, fusion, graph, lexical, nearest, records, store, tracing
from tessera.session import ship, stored
from tessera.sources import files as sources

#: Known intents, those that read the call graph, directions of expansion.
INTENTS = ("find_function", "understand_flow", "find_usage", "debug", "explain_concept")
GRAPH_INTENTS = ("understand_flow", "find_usage", "debug")
DIRECTIONS = ("callees", "callers", "both")
DIMENSIONS = 64


def embedded(rows: DataFrame, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Stand-in embedder: ``rows`` with ``vector``, signed token hashes summed over ``dimensions`` and brought to length 1."""
    ship(rows.sparkSession)
    marked = rows.withColumn("_hashes", F.transform(text.tokens(F.col(text_col)), lambda w: F.xxhash64(w)))
    schema = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ends = np.asarray(column.offsets) - column.offsets[0].as_py()
            h = column.flatten().to_numpy(zero_copy_only=False)
            sums = np.zeros((len(column), dimensions))
            np.add.at(sums, (np.repeat(np.arange(len(column)), np.diff(ends)), h % dimensions), np.where((h >> 40) % 2 == 0, 1.0, -1.0))
            unit = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-9)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dimensions), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=schema.names)

    return marked.mapInArrow(run, schema)


def lexical_scorer(question: Column, document: Column) -> Column:
    """Stand-in reranker: share of the question's stemmed terms that the document has, in [0, 1]."""
    return F.round(text.overlap(text.haystack_terms(question), text.haystack_terms(document)), 4)


def rerank_text() -> Column:
    """What a reranker reads of a chunk."""
    return F.concat_ws("\n", "name", "type", "file", "docstring", F.array_join("calls", ", "), F.array_join("called_by", ", "), "raw_source")


def normalise_rewrites(answers: DataFrame) -> DataFrame:
    """(question, summary, phrases, intent, direction, depth) from a model's noisy JSON (question, answer).

    Whatever is missing or out of bounds takes its default: the question itself, find_function, both, depth 1; at
    most eight phrases; depth 1 or 2.
    """
    kind = "implementation_summary string, phrases array<string>, intent string, graph struct<direction:string,depth:int,entry:string>"
    r = answers.withColumn("r", F.from_json(text.json_object(F.col("answer")), kind))
    phrases = F.filter(F.coalesce("r.phrases", F.array().cast("array<string>")), lambda p: F.trim(p) != "")
    return r.select(
        "question", F.coalesce(F.when(F.trim("r.implementation_summary") != "", F.col("r.implementation_summary")), F.col("question")).alias("summary"),
        F.when(F.size(phrases) > 0, F.slice(phrases, 1, 8)).otherwise(F.array("question")).alias("phrases"),
        F.when(F.col("r.intent").isin(*INTENTS), F.col("r.intent")).otherwise("find_function").alias("intent"),
        F.when(F.col("r.graph.direction").isin(*DIRECTIONS), F.col("r.graph.direction")).otherwise("both").alias("direction"),
        F.least(F.greatest(F.coalesce("r.graph.depth", F.lit(1)), F.lit(1)), F.lit(2)).alias("depth"), F.col("r.graph.entry").alias("entry"),
    )


@dataclass(frozen=True)
class Repository:
    """Chunks with callers, their vectors (id, vector), the lexical index and the profile."""

    chunks: DataFrame
    vectors: DataFrame
    index: lexical.Index
    profile: DataFrame


#: An embedder adds ``vector`` to rows, from the named text column.
Embedder = Callable[[DataFrame, str], DataFrame]


def with_callers(chunks: DataFrame) -> DataFrame:
    called = graph.invert(chunks)
    return chunks.drop("called_by").join(called, "id", "left").withColumn("called_by", F.coalesce("called_by", F.array().cast("array<string>")))


def build(chunks: DataFrame, embed: Embedder = embedded) -> Repository:
    """Callers, vectors, the lexical index and the profile of chunks; chunks and vectors are written once."""
    whole = stored(with_callers(chunks))
    vectors = stored(embed(whole.select("id", "text"), "text").select("id", "vector"))
    return Repository(whole, vectors, lexical.build_index(whole, F.col("id"), F.col("text"), F.col("name")), store.repo_profile(whole))


def ingest(spark: SparkSession, root: str, repo_id: str, embed: Embedder = embedded) -> Repository:
    """All Python files under ``root``."""
    return build(chunking.chunk_python(sources.scan_python_files(spark, root), repo_id), embed)


def embed_misses(chunks: DataFrame, cache: DataFrame, embed: Embedder = embedded) -> tuple[DataFrame, DataFrame]:
    """((id, vector) of all chunks, (text_md5, vector) of the texts that the cache lacked): only those are embedded, each once."""
    keyed = chunks.select("id", "text", F.md5("text").alias("text_md5"))
    missing = keyed.join(cache.select("text_md5"), "text_md5", "left_anti").dropDuplicates(["text_md5"]).select("text_md5", "text")
    fresh = embed(missing, "text").select("text_md5", "vector")
    return keyed.join(cache.select("text_md5", "vector").unionByName(fresh), "text_md5").select("id", "vector"), fresh


@dataclass(frozen=True)
class Synced:
    """What a sync leaves: the new chunks and vectors, rows for the embedding cache, answers still valid, counters."""

    chunks: DataFrame
    vectors: DataFrame
    fresh: DataFrame
    answers: DataFrame | None
    counters: DataFrame


def sync(
    old: DataFrame, old_files: DataFrame, new_files: DataFrame, repo_id: str, *, vectors: DataFrame | None = None, cache: DataFrame | None = None,
    answers: DataFrame | None = None, embed: Embedder = embedded,
) -> Synced:
    """After files changed: only changed files are parsed, only texts the cache lacks are embedded, stored vectors of removed
    chunks go, callers are made anew over all chunks, and the repository's cached answers are dropped if anything changed.

    ``old`` are the stored chunks, the others (path, content) of both trees. The chunks equal a full rebuild's.
    """
    spark = old.sparkSession
    changed = sources.changed_files(sources.snapshot(old_files), sources.snapshot(new_files))
    parsed = chunking.chunk_python(new_files.join(changed.where("status <> 'removed'"), "path", "left_semi"), repo_id)
    kept = old.join(changed.select(F.col("path").alias("file")), "file", "left_anti")
    whole = with_callers(kept.drop("called_by").unionByName(parsed.drop("called_by")))
    difference = store.snapshot_difference(old.select("id", "content_hash"), whole.select("id", "content_hash"))
    known = cache if cache is not None else spark.createDataFrame([], "text_md5 string, vector array<double>")
    made, fresh = embed_misses(whole.join(difference.where("status <> 'unchanged'").select("id"), "id", "left_semi"), known, embed)
    if vectors is not None:
        made = store.upsert(vectors.join(whole.select("id"), "id", "left_semi"), made)
    if answers is not None:
        now = changed.limit(1).select(F.lit(repo_id).alias("repo_id"), F.current_timestamp().alias("synced_at"))
        answers = records.invalidated(answers, now)
    return Synced(whole, made, fresh, answers, store.counters(difference))


def hybrid(repo: Repository, questions: DataFrame, top_k: int = 20, embed: Embedder = embedded, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """(rows, counts) for plain questions (question, question_text): fused hits with their payload, or with mode ``vector``
    those of the vectors alone; counts are each list's hits."""
    vector = nearest.nearest(repo.vectors, embed(questions.select("question", "question_text"), "question_text").select("question", "vector"), top_k)
    words = lexical.search(repo.index, questions, F.col("question"), F.col("question_text"), top_k).withColumnRenamed("doc", "id")
    none = words.select("question", "id", "rank")
    rows = fusion.with_payload(fusion.fuse(vector, none if mode == "hybrid" else none.limit(0), top_k), repo.chunks, vector)
    rows = fusion.exact_first(rows.join(questions.select("question", "question_text"), "question"))
    each = lambda hits, name: hits.groupBy("question").agg(F.count(F.lit(1)).alias(name))
    counts = questions.select("question").join(each(vector, "vector_hits"), "question", "left").join(each(words, "keyword_hits"), "question", "left")
    return rows, counts.na.fill(0, ["vector_hits", "keyword_hits"])


def baseline_search(repo: Repository, questions: DataFrame, generate: Callable[[Column], Column], top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits, answers): the hits with the first 300 characters of their source, and what is generated from their blocks."""
    rows, _ = hybrid(repo, questions, top_k)
    held = context.search_context(rows).join(questions, "question")
    prompt = F.concat(F.col("context"), F.lit("\n\nQuestion: "), F.col("question_text"))
    return context.excerpts(rows), held.select("question", generate(prompt).alias("answer"))


def retrieve(
    repo: Repository, questions: DataFrame, *, top_k: int = 20, embed: Embedder = embedded, expand_graph: bool = True, max_expanded: int = 15,
    keep_state: Callable[[DataFrame], DataFrame] = stored,
) -> DataFrame:
    """Hybrid retrieval for rewritten questions (question, question_text, summary, phrases, intent, direction, depth).

    The question's and the summary's vectors are searched apart and their lists joined end to end; the question,
    its phrases and the symbols found for them are searched lexically, a chunk keeping its best score; both are
    fused, production code preferred, an exact name put first; for intents that ask for it, the best five are
    expanded along the call graph and what is new is appended. ``keep_state`` keeps what is read several times
    (cached, or written as a table); only what a hop reaches is resolved in the call graph.
    """
    asked = lambda c: embed(questions.select("question", c), c).select("question", "vector")
    first = nearest.nearest(repo.vectors, asked("question_text"), top_k)
    second = nearest.nearest(repo.vectors, asked("summary"), top_k)
    vector_hits = fusion.concatenated(first, second)
    names = repo.chunks.select(F.col("id").alias("doc"), "name")
    symbols = lexical.expand_symbols(repo.index, names, questions.select("question", F.posexplode("phrases").alias("pos", "phrase")))
    terms = symbols.select("question", F.col("symbol").alias("term")).unionByName(questions.select("question", F.col("question_text").alias("term"))).distinct()
    words = lexical.best_over_terms(repo.index, terms, F.col("question"), F.col("term")).withColumnRenamed("doc", "id")
    rows = fusion.with_payload(fusion.fuse(vector_hits, words, top_k), repo.chunks, vector_hits)
    rows = fusion.exact_first(fusion.prefer_production(rows).join(questions.select("question", "question_text", "intent"), "question"))
    rows = rows.withColumn("graph_distance", F.lit(0))
    if not expand_graph:
        return rows
    rows = keep_state(rows)

    def edges(frontier: DataFrame) -> DataFrame:
        made = None
        for side in ("callees", "callers"):
            one = graph.neighbour_edges(repo.chunks, side, of=frontier)
            one = one.withColumn("direction", F.explode(F.array(F.lit(side), F.lit("both"))))
            made = one if made is None else made.unionByName(one)
        return made

    best = rows.join(questions.where(F.col("intent").isin(*GRAPH_INTENTS)).select("question", "direction", "depth"), "question").where("retrieval_rank < 5")
    seeds = best.select("question", "direction", "depth", "id", "score", F.col("retrieval_rank").alias("pos"))
    added = graph.expand(seeds, edges, 2, max_expanded, keep_state).where("graph_distance > 0")
    new = added.join(rows.select("question", "id"), ["question", "id"], "left_anti").join(repo.chunks, "id").withColumnRenamed("graph_score", "score")
    new = new.join(questions.select("question", "question_text", "intent"), "question").withColumn("retrieval_rank", F.lit(1000) + F.col("graph_distance"))
    return rows.unionByName(new.select(*rows.columns))


def rerank(rows: DataFrame, top_n: int = 12, cap: int = 35, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """The best ``top_n`` by the scorer, out of the first ``cap`` of each question; ``score`` becomes the scorer's."""
    from pyspark.sql import Window

    first = Window.partitionBy("question").orderBy("retrieval_rank", "id")
    some = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap)
    scored = some.withColumn("score", scorer(F.col("question_text"), rerank_text()))
    best = Window.partitionBy("question").orderBy(F.desc("score"), "_n")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n).drop("_n")


@dataclass(frozen=True)
class Answers:
    """(question, prompt) of what can be answered, (question, rank, ...) of what is cited, the verdict, what the rest are told."""

    prompts: DataFrame
    sources: DataFrame
    low: DataFrame
    misses: DataFrame


def answer_prompts(repo: Repository, questions: DataFrame, instructions: DataFrame | None = None, *, top_n: int = 12, max_tokens: int = context.MAX_TOKENS) -> Answers:
    """A prompt for each question that retrieval is confident of; chunks of questions about a flow come in the order of calls."""
    ranked = stored(rerank(retrieve(repo, questions), top_n))
    low = context.low_confidence(ranked, questions)
    sure = ranked.join(low.where("not low").select("question"), "question", "left_semi")
    chosen = context.select_context(sure.select("question", "intent", "question_text", "id", "name", "type", "file", "text", "calls", "called_by", "score"), max_tokens)
    flow = graph.call_order(chosen.where("intent = 'understand_flow'").withColumn("rank", F.col("context_pos")), graph.LIFECYCLE)
    ordered = chosen.where("intent <> 'understand_flow' or intent is null").unionByName(flow.withColumn("context_pos", F.col("call_pos")).select(*chosen.columns))
    return Answers(context.prompts(ordered, instructions), context.sources(sure), low, context.nearest_misses(ranked, low))


def answers(repo: Repository, questions: DataFrame, generate: Callable[[Column], Column], instructions: DataFrame | None = None) -> DataFrame:
    """(question, answer, sources): generated from the prompt, or the plain word that nothing was found and what came nearest."""
    made = answer_prompts(repo, questions, instructions)
    fields = ("name", "file", "score")
    cited = made.sources.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("l"))
    cited = cited.select("question", F.transform("l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("sources"))
    sure = made.prompts.select("question", generate(F.col("prompt")).alias("answer")).join(cited, "question")
    return sure.unionByName(made.misses.select("question", "answer", F.col("top").alias("sources")))


def answer_events(answered: DataFrame, words: str = " ") -> Iterator[tuple]:
    """(question, event, data) of each answer as a stream tells it: its sources, its words one by one, then done."""
    for row in answered.toLocalIterator():
        yield row.question, "sources", [s.asDict() for s in row.sources]
        for token in row.answer.split(words):
            yield row.question, "token", token
        yield row.question, "done", ""


def agentic_evidence(repo: Repository, questions: DataFrame, keep_state: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(evidence, trace) of the iterative retriever for questions whose intent reads the call graph."""
    def found(some: DataFrame, size: int) -> DataFrame:
        rows, _ = hybrid(repo, some, size)
        return rows.select("question", "id", "name", "type", "file", "raw_source", "calls", "called_by", "score")

    def expanded(chosen: DataFrame) -> DataFrame:
        seeds = chosen.join(repo.chunks.select("id", F.col("name").alias("symbol")), "symbol").select("question", "id", F.lit(1.0).alias("score"), F.lit(0).alias("pos"))
        near = graph.expand(seeds, lambda f: graph.neighbour_edges(repo.chunks, of=f), 1, keep=keep_state)
        return near.join(repo.chunks, "id").select("question", "id", "name", "type", "file", "raw_source", "calls", "called_by", F.col("graph_score").alias("score"))

    return agent.run(questions.where(F.col("intent").isin(*GRAPH_INTENTS)).select("question", "question_text"), found, expanded, keep_state)


def symbol_graph(repo: Repository, name: str, depth: int = 2, max_nodes: int = 40) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the chunks of a name; each hop resolves the calls of what it reached only."""
    chunks = repo.chunks
    seeds = chunks.where(F.col("name") == name).select(F.lit(name).alias("question"), "id", F.lit(1.0).alias("score"), F.lit(0).alias("pos"))
    reached = graph.ordered(graph.expand(seeds, lambda f: graph.neighbour_edges(chunks, of=f), depth, max_nodes))
    nodes = reached.join(chunks, "id").select("id", "name", "type", "file", "calls", "graph_distance", (F.col("graph_distance") == 0).alias("is_entry"))
    nodes = stored(nodes)
    return nodes, graph.explorer_edges(nodes)


def evaluate(repo: Repository, limit: int = 100, embed: Embedder = embedded) -> tuple[DataFrame, DataFrame]:
    """(summary, recall per file) of hybrid search, ten hits a list, over the golden set."""
    golden = evaluation.golden_set(repo.chunks, limit)
    asked = golden.select("question").distinct()
    vector = nearest.nearest(repo.vectors, embed(asked, "question").select("question", "vector"), 10)
    words = lexical.search(repo.index, asked, F.col("question"), F.col("question"), 10).withColumnRenamed("doc", "id")
    ranks = evaluation.ranks_of(golden, fusion.fuse(vector, words, 10))
    return evaluation.summary(ranks), evaluation.recall_per_file(ranks, worst=5)


def cached_answers(asked: DataFrame) -> DataFrame:
    """Requests (repo_id, question, top_k, ts) with the key they are cached under and whether they hit."""
    from tessera.functions.ids import cache_key

    keyed = asked.withColumn("key", cache_key(F.col("repo_id"), F.col("question"), F.col("top_k")))
    return tracing.with_cache_hits(keyed, ["key"])

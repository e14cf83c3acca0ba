"""Queries of the engine's own operators over the driver's tables, each with its DuckDB equivalent.

The tables hold no source code, so operators run on stand-ins: documents as chunks (source as name), benchmark
texts as questions, pages as callers of what they link to, supplier-part edges as a call graph, conversations as
candidates for a prompt.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, text, vectors
from tessera.operators import agent, chunks, context, evaluation, fusion, graph, lexical, nearest, records, store, tracing
from tessera.plans import fixtures, retrieval
from tessera.session import scratch, table
from tessera.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        name = fn.__name__.lstrip("_")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


# Fragments of SQL that several queries share.
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
_INDEX = f"""
d AS (SELECT doc_id AS doc, {_TOKENS.format("text || ' ' || source")} AS w FROM documents),
l AS (SELECT doc, len(w) AS dl FROM d),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM d) GROUP BY ALL),
r AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, tot GROUP BY term),
t AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)"""
_SCORES = """
s AS (SELECT q.question, p.doc, round(sum(q.qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN p USING (term) JOIN t USING (term) JOIN l USING (doc), tot GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc) AS rank FROM s)"""
_ASKED = f"q AS (SELECT item_id AS question, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL)"
_BM25 = f"WITH {_INDEX}, {_ASKED}, {_SCORES}"
_KNN = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
kn AS (SELECT a.vec_id AS question, b.vec_id AS id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 {0}),
kr AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, id) AS rank FROM kn)"""


def _index(spark: SparkSession, d: str) -> lexical.Index:
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    return lexical.build_index(docs, F.col("doc_id"), F.col("text"), F.col("source"))


def _bm25_hits(spark: SparkSession, d: str, top_k: int = 20) -> DataFrame:
    return lexical.search(_index(spark, d), table(spark, d, "benchmark"), F.col("item_id"), F.col("text"), top_k)


def _vector_hits(spark: SparkSession, d: str, top_k: int = 20) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    return nearest.nearest(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, top_k)


def _stored(spark: SparkSession, d: str, repo_id: str | None = None) -> DataFrame:
    """documents in a chunk store: a folder for each language, as one for each repository."""
    path = f"{scratch(spark)}/chunks-{uuid.uuid4().hex}"
    tables.write_chunks(table(spark, d, "documents", "doc_id", "lang", "source", "n_chars").withColumnRenamed("lang", "repo_id"), path)
    return tables.read_chunks(spark, path, repo_id)


# -- scans, lookups, hashes ---------------------------------------------------------------------------------------


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'de' AND n_chars > 500")
def scan_filter_project(spark, d):
    return _stored(spark, d, "de").where("n_chars > 500").select("doc_id", "source", "n_chars")


@query("SELECT doc_id AS id, lang, 0.0::DOUBLE AS score FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def point_lookup(spark, d):
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return store.lookup(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), wanted)


@query("SELECT lang, count(*) AS n_rows FROM documents GROUP BY lang")
def count_per_partition(spark, d):
    return tables.partition_counts(_stored(spark, d)).select(F.col("repo_id").alias("lang"), "n_rows")


@query(f"SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)")
def tokenize_stats(spark, d):
    w = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("""
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || ':' || doc_id)) AS s FROM documents)
SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' ||
  substr('89ab', (('0x' || substr(s, 17, 1))::INT % 4 + 1)::INT, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id FROM h""")
def uuid5_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.uuid5(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("id"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT item_id, 'qcache:' || md5('q:repo:' || text || ':5') AS cache_key FROM benchmark")
def answer_cache_keys(spark, d):
    return table(spark, d, "benchmark").select("item_id", ids.cache_key(F.lit("repo"), F.col("text"), F.lit(5)).alias("cache_key"))


# -- lexical and vector search, fusion ----------------------------------------------------------------------------


@query(f"WITH {_INDEX} SELECT any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl, count(*) AS vocabulary, round(avg(idf), 6) AS mean_idf FROM t, tot")
def bm25_index_stats(spark, d):
    index = _index(spark, d)
    return index.terms.crossJoin(F.broadcast(index.totals)).agg(
        F.any_value("n").alias("n"), F.round(F.any_value("avgdl"), 6).alias("avgdl"), F.count(F.lit(1)).alias("vocabulary"), F.round(F.avg("idf"), 6).alias("mean_idf")
    )


@query(f"{_BM25} SELECT question, doc, rank::INT AS rank, round(score, 4) AS bm25_score FROM h WHERE rank <= 20 AND score > 0")
def bm25_topk(spark, d):
    return _bm25_hits(spark, d)


@query(f"""
WITH {_INDEX}, q AS (SELECT item_id || '|' || term AS question, term, 1 AS qtf FROM (SELECT DISTINCT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark)), {_SCORES},
b AS (SELECT string_split(question, '|')[1]::BIGINT AS question, doc, max(round(score, 4)) AS bm25_score FROM h WHERE rank <= 25 AND score > 0 GROUP BY ALL)
SELECT question, doc, row_number() OVER (PARTITION BY question ORDER BY bm25_score DESC, doc)::INT AS rank, bm25_score FROM b""")
def bm25_multi_term_max(spark, d):
    terms = table(spark, d, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return lexical.best_over_terms(_index(spark, d), terms, F.col("item_id"), F.col("term"))


@query(f"""
WITH {_INDEX}, ph AS (SELECT item_id, i AS pos, w[i + 1] AS phrase FROM (SELECT item_id, {_TOKENS.format('text')} AS w FROM benchmark), unnest(range(len(w))) x(i)),
kp AS (SELECT * FROM ph WHERE phrase IS NOT NULL AND phrase NOT IN ({", ".join(f"'{w}'" for w in text.PHRASE_STOP_WORDS)})),
q AS (SELECT item_id || '|' || pos AS question, phrase AS term, 1 AS qtf FROM kp), {_SCORES},
f AS (SELECT string_split(question, '|')[1]::BIGINT AS item_id, doc, min((string_split(question, '|')[2]::INT, rank)) AS pl FROM h WHERE rank <= 5 AND score > 0 GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pl, doc) AS n FROM f),
u AS (SELECT item_id, 0 AS kind, pos AS n, phrase AS symbol FROM kp UNION ALL SELECT item_id, 1, n, source FROM c JOIN documents ON doc = doc_id WHERE n <= 10),
o AS (SELECT item_id, symbol, min((kind, n)) AS pl FROM u GROUP BY ALL)
SELECT item_id AS question, row_number() OVER (PARTITION BY item_id ORDER BY pl)::INT AS pos, symbol FROM o""")
def symbol_expansion(spark, d):
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.posexplode(text.tokens(F.col("text"))).alias("pos", "phrase"))
    names = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("name"))
    return lexical.expand_symbols(_index(spark, d), names, phrases)


@query(f"WITH {_KNN.format('')} SELECT question, id, rank::INT AS rank, round(score, 4) AS score FROM kr WHERE rank <= 20")
def knn_topk(spark, d):
    return _vector_hits(spark, d)


@query(f"WITH {_KNN.format('AND a.label = b.label')} SELECT question, id, rank::INT AS rank, round(score, 4) AS score FROM kr WHERE rank <= 20")
def knn_filtered(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("embedding", "vector")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), "vector", "label")
    return nearest.nearest(v.select(F.col("vec_id").alias("id"), "vector", "label"), asked, within="label")


@query("""
WITH c AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS x FROM embeddings, range(64) r(i) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label)
SELECT label, i::INT AS i, round(x / greatest(n, 1e-9), 6) AS x FROM c JOIN n USING (label)""")
def mean_pool_norm(spark, d):
    pooled = nearest.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


_FUSED = f"""{_BM25}, {_KNN.format('')},
hits AS (SELECT question, id, 0 AS kind, rank, 0.6::DOUBLE / (60 + rank) AS part FROM kr WHERE rank <= 20
  UNION ALL SELECT question, doc, 1, rank, 0.4::DOUBLE / (60 + rank) FROM h WHERE rank <= 20 AND score > 0),
fs AS (SELECT question, id, round(sum(part), 12) AS score, min((kind, rank)) AS pl FROM hits GROUP BY ALL),
fu AS (SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, pl, id) AS rank FROM fs)"""


@query(f"{_FUSED} SELECT question, id, rank::INT AS rank, round(score, 9) AS score FROM fu WHERE rank <= 20")
def rrf_fusion(spark, d):
    words = _bm25_hits(spark, d).select("question", F.col("doc").alias("id"), "rank")
    return fusion.fuse(_vector_hits(spark, d), words).withColumn("score", F.round("score", 9))


@query(f"""
WITH {_KNN.format('')}, a AS (SELECT question, id, rank FROM kr WHERE rank <= 20 AND question % 200 = 0),
b AS (SELECT question - 100 AS question, id, rank FROM kr WHERE rank <= 20 AND question % 200 = 100)
SELECT question, id, rank::INT AS rank FROM a UNION ALL
SELECT b.question, b.id, (b.rank + coalesce(n, 0))::INT FROM b LEFT JOIN (SELECT question, max(rank) AS n FROM a GROUP BY question) m USING (question)""")
def rrf_concat_lists(spark, d):
    hits = _vector_hits(spark, d).select("question", "id", "rank")
    second = hits.where("question % 200 = 100").withColumn("question", F.col("question") - 100)
    return fusion.concatenated(hits.where("question % 200 = 0"), second).select("question", "id", F.col("rank").cast("int").alias("rank"))


@query(f"""{_FUSED}, j AS (
  SELECT fu.question, fu.id, source AS name, 'src/' || CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'tests/' ELSE '' END || source AS file,
    round(coalesce(v.score, 0), 4) AS score, fu.rank - 1 AS r, b.text AS qt
  FROM fu JOIN documents ON doc_id = fu.id JOIN benchmark b ON item_id = fu.question LEFT JOIN (SELECT * FROM kr WHERE rank <= 20) v ON v.question = fu.question AND v.id = fu.id WHERE fu.rank <= 20),
m AS (SELECT *, file NOT LIKE '%/tests/%' AS prod, bool_or(file NOT LIKE '%/tests/%') OVER (PARTITION BY question) AS anyp FROM j)
SELECT question, id, name, score, CASE WHEN lower(name) = lower(trim(qt)) THEN -1 ELSE r END::INT AS retrieval_rank FROM m WHERE prod OR NOT anyp""")
def hybrid_search(spark, d):
    words = _bm25_hits(spark, d).select("question", F.col("doc").alias("id"), "rank")
    vector = _vector_hits(spark, d)
    test = F.col("source").isin("src0", "src1", "src2", "src3")
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.concat(F.lit("src/"), F.when(test, "tests/").otherwise(""), F.col("source")).alias("file")
    )
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("question_text"))
    rows = fusion.with_payload(fusion.fuse(vector, words), docs, vector).join(asked, "question")
    return fusion.exact_first(fusion.prefer_production(rows)).select("question", "id", "name", "score", F.col("retrieval_rank").cast("int").alias("retrieval_rank"))


# -- evaluation ----------------------------------------------------------------------------------------------------


@query("SELECT 'What does ' || source || ' do?' AS question, doc_id AS expected_id, lang AS file, source AS name FROM documents WHERE length(text) >= 15 ORDER BY doc_id LIMIT 100")
def golden_set(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("file"), F.col("text").alias("docstring"))
    return evaluation.golden_set(docs)


def _ranks(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    held = evaluation.containing(docs, items).groupBy("question").agg(F.min(F.struct("doc_id", "source")).alias("t"))
    expected = items.join(held, "question", "left").select("question", F.col("t.doc_id").alias("expected_id"), F.coalesce("t.source", F.lit("none")).alias("file"))
    return evaluation.ranks_of(expected, _bm25_hits(spark, d, 10).select("question", F.col("doc").alias("id"), "rank"))


_RANKS = f"""{_BM25}, ex AS (SELECT item_id AS question, (SELECT min((doc_id, source)) FROM documents WHERE contains(documents.text, benchmark.text)) AS t FROM benchmark),
rk AS (SELECT ex.question, coalesce(t[2], 'none') AS file, h.rank FROM ex LEFT JOIN h ON h.question = ex.question AND h.doc = t[1] AND h.rank <= 10 AND h.score > 0)"""


@query(f"""{_RANKS} SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_5,
round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr,
round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 4) AS ndcg_at_5, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 4) AS ndcg_at_10 FROM rk""")
def eval_summary(spark, d):
    return evaluation.summary(_ranks(spark, d))


@query(f"{_RANKS}, a AS (SELECT file, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall, count(*) AS questions FROM rk GROUP BY file) SELECT * FROM a ORDER BY recall, file LIMIT 5")
def per_source_recall(spark, d):
    return evaluation.recall_per_file(_ranks(spark, d), worst=5)


@query("""
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, round(v[(round_even(0.5 * (len(v) - 1), 0) + 1)::BIGINT], 1) AS p50, round(v[(round_even(0.95 * (len(v) - 1), 0) + 1)::BIGINT], 1) AS p95,
  round(v[(round_even(0.99 * (len(v) - 1), 0) + 1)::BIGINT], 1) AS p99 FROM s""")
def latency_percentiles(spark, d):
    return evaluation.percentiles(table(spark, d, "events"), "value", "event_type")


# -- traces and caches ---------------------------------------------------------------------------------------------


def _stages(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("user_id").alias("request"), F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"), F.coalesce(k, F.lit(0)).alias("tokens_in"),
        (F.coalesce(k, F.lit(0)) * 2).alias("tokens_out"), (F.col("event_type") == "click").alias("cache_hit"), "ts",
    )


@query("""
WITH s AS (SELECT user_id AS request, event_type AS stage, value, coalesce((props->>'$.k')::BIGINT, 0) AS k FROM events)
SELECT request, count(*) AS stages, round(sum(value), 3) AS total_ms, sum(k)::BIGINT AS tokens_in, sum(2 * k)::BIGINT AS tokens_out,
  round(sum(round(k / 1e6 * 0.05::DOUBLE + 2 * k / 1e6 * 0.08::DOUBLE, 6)), 6) AS cost_usd,
  coalesce(list_sort(list(DISTINCT stage) FILTER (stage = 'click')), []) AS hit_stages FROM s GROUP BY request""")
def trace_cost(spark, d):
    return tracing.requests(_stages(spark, d))


@query("SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type <> 'click') AS misses, round(count(*) FILTER (event_type = 'click') * 100.0::DOUBLE / greatest(1, count(*)), 1) AS hit_rate_pct FROM events")
def cache_hit_rate(spark, d):
    return tracing.hit_rate(table(spark, d, "events"), F.col("event_type") == "click")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
w(event_id, user_id, event_type, ts, n, written, hit) AS (
  SELECT event_id, user_id, event_type, ts, n, ts, false FROM r WHERE n = 1
  UNION ALL SELECT r.event_id, r.user_id, r.event_type, r.ts, r.n, CASE WHEN r.ts - w.written < INTERVAL 300 SECOND THEN w.written ELSE r.ts END, r.ts - w.written < INTERVAL 300 SECOND
  FROM w JOIN r ON r.user_id = w.user_id AND r.event_type = w.event_type AND r.n = w.n + 1)
SELECT event_id, user_id, event_type, ts, hit FROM w""")
def ttl_cache_hits(spark, d):
    asked = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return tracing.with_cache_hits(asked, ["user_id", "event_type"])


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS status FROM events GROUP BY ALL")
def status_last(spark, d):
    changes = table(spark, d, "events").withColumn("key", F.struct("user_id", "event_type"))
    return tracing.last_status(changes, "key", "value", F.struct("ts", "event_id")).select("key.*", "status")


_SNAPSHOT = """
old AS (SELECT doc_id, source, md5(text || CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT -doc_id - 1, source, md5(text) FROM documents WHERE doc_id % 13 = 0),
new AS (SELECT doc_id, source, md5(text) AS h FROM documents)"""


def _snapshots(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), "text")
    own = F.md5(F.concat("text", F.when(F.col("id") % 11 == 0, "x").otherwise("")))
    old = docs.where("id % 7 <> 0").select("id", "file", own.alias("content_hash"))
    gone = docs.where("id % 13 = 0").select((-F.col("id") - 1).alias("id"), "file", F.md5("text").alias("content_hash"))
    return old.unionByName(gone), docs.select("id", "file", F.md5("text").alias("content_hash"))


_STATUS = "CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END"


@query(f"WITH {_SNAPSHOT} SELECT coalesce(new.doc_id, old.doc_id) AS id, {_STATUS} AS status FROM old FULL JOIN new USING (doc_id)")
def hash_diff(spark, d):
    return store.snapshot_difference(*_snapshots(spark, d))


@query(f"WITH {_SNAPSHOT} SELECT doc_id AS id FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.doc_id = new.doc_id AND old.h = new.h)")
def changed_to_embed(spark, d):
    old, new = _snapshots(spark, d)
    return store.to_embed(new, old).select("id")


@query(f"WITH {_SNAPSHOT} SELECT doc_id AS id FROM old WHERE source IN ('src1', 'src2', 'src3') AND doc_id NOT IN (SELECT doc_id FROM new)")
def obsolete_rows(spark, d):
    old, new = _snapshots(spark, d)
    return store.obsolete(old, new.where(F.col("file").isin("src1", "src2", "src3")), new).select("id")


@query(f"WITH {_SNAPSHOT} SELECT doc_id AS id, h AS content_hash FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT doc_id, h FROM new")
def upsert_merge(spark, d):
    return store.upsert(*_snapshots(spark, d)).select("id", "content_hash")


@query(f"""WITH {_SNAPSHOT}, s AS (SELECT {_STATUS} AS status FROM old FULL JOIN new USING (doc_id))
SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'removed') AS removed,
  count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status IN ('added', 'changed')) AS embedded FROM s""")
def incremental_counts(spark, d):
    return store.counters(store.snapshot_difference(*_snapshots(spark, d)))


@query("WITH c AS (SELECT DISTINCT md5(text) AS m FROM documents WHERE doc_id % 2 = 0) SELECT count(*) FILTER (m IS NOT NULL) AS cached, count(*) FILTER (m IS NULL) AS fresh FROM documents LEFT JOIN c ON md5(text) = m")
def embed_cache_probe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select(F.md5("text").alias("text_md5")).distinct()
    return store.probe_cache(docs, cache).agg(F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("fresh"))


@query("""
WITH r AS (SELECT lang, source AS name, doc_id, n_chars, doc_id % 3 = 0 AS c FROM documents),
g AS (SELECT lang, c, name, min(({'f': name, 'l': doc_id % 100, 'i': doc_id})) AS pl FROM r GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, c ORDER BY pl) AS n FROM g),
m AS (SELECT lang, name, row_number() OVER (PARTITION BY lang ORDER BY pl) AS n FROM (SELECT lang, name, min(({'f': name, 'l': doc_id % 100, 'i': doc_id})) AS pl FROM r GROUP BY ALL))
SELECT lang, 'Classes: ' || coalesce((SELECT string_agg(name, ', ' ORDER BY n) FROM o WHERE o.lang = x.lang AND c AND n <= 20), '') || chr(10) ||
  'Functions: ' || coalesce((SELECT string_agg(name, ', ' ORDER BY n) FROM o WHERE o.lang = x.lang AND NOT c AND n <= 30), '') || chr(10) ||
  'Imports: ' || coalesce((SELECT string_agg(name, ', ' ORDER BY n) FROM m WHERE m.lang = x.lang AND n <= 15), '') AS profile
FROM (SELECT DISTINCT lang FROM documents) x""")
def repo_profile(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("lang").alias("repo_id"), F.col("source").alias("file"), F.col("source").alias("name"), F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("line_start"),
        F.when(F.col("doc_id") % 3 == 0, "class").otherwise("function").alias("type"), F.array("source").alias("imports"),
    )
    return store.repo_profile(docs).select(F.col("repo_id").alias("lang"), "profile")


# -- graph ---------------------------------------------------------------------------------------------------------

_LINKS = "l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))) AS target FROM pages)"


@query(f"WITH {_LINKS} SELECT target, list_sort(list(DISTINCT url)) AS called_by FROM l GROUP BY target")
def call_graph_inversion(spark, d):
    callers = graph.pages_as_chunks(table(spark, d, "pages"))
    targets = callers.select(F.explode("calls").alias("name")).distinct()
    known = callers.withColumn("type", F.lit("page")).select(F.col("name").alias("id"), "name", "type", "calls")
    called = targets.select(F.col("name").alias("id"), "name", F.lit("function").alias("type"), F.array().cast("array<string>").alias("calls"))
    return graph.invert(known.unionByName(called)).select(F.col("id").alias("target"), "called_by")


@query(f"""WITH {_LINKS}, n AS (SELECT DISTINCT target AS name FROM l), x AS (SELECT url AS source, target FROM l WHERE target IN (SELECT name FROM n))
SELECT DISTINCT source, target FROM x""")
def explorer_edges(spark, d):
    pages = graph.pages_as_chunks(table(spark, d, "pages"))
    targets = pages.select(F.explode("calls").alias("name")).distinct()
    return graph.explorer_edges(pages.select("name", "calls").unionByName(targets.withColumn("calls", F.array().cast("array<string>"))))


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_type AS type, total FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n, count(DISTINCT p_name) OVER () AS total FROM part WHERE contains(lower(p_name), 'a')) WHERE n = 1 ORDER BY p_partkey LIMIT 20")
def symbol_search(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("type"))
    return graph.find_symbols(parts, "A")


def _edges(spark, d):
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    down = pairs.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    both = down.unionByName(down.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.withColumn("tier", F.lit(1)).withColumn("name", F.col("dst"))


def _seeds(spark, d):
    return _edges(spark, d).where(F.startswith("src", F.lit("s"))).select("src").distinct().select(
        F.col("src").alias("question"), F.col("src").alias("id"), F.lit(1.0).alias("score"), F.lit(0).alias("pos")
    )


_EDGES = """p AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS t FROM lineitem),
e AS (SELECT s AS src, t AS dst FROM p UNION ALL SELECT t, s FROM p)"""


@query(f"""WITH RECURSIVE {_EDGES}, w(question, id, hop) AS (SELECT DISTINCT s, s, 0 FROM p UNION SELECT question, dst, hop + 1 FROM w JOIN e ON src = id WHERE hop < 2)
SELECT question, id, min(hop)::INT AS graph_distance, round(1.0::DOUBLE - 0.05::DOUBLE * min(hop), 9) AS graph_score FROM w GROUP BY ALL""")
def bfs_expand(spark, d):
    return graph.expand(_seeds(spark, d), _edges(spark, d), depth=2, max_expanded=None)


def _capped_sql(depth: int, cap: int) -> str:
    """Hop by hop: first visits in the order of their parents, then as many rows as the cap leaves, one at least."""
    steps = ["h0 AS (SELECT DISTINCT s AS question, s AS id, 0 AS hop, 0 AS pos FROM p)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT * FROM h{j}" for j in range(k))
        steps += [
            f"r{k} AS ({seen})", f"t{k} AS (SELECT question, count(*) FILTER (hop > 0) AS taken FROM r{k} GROUP BY question)",
            f"v{k} AS (SELECT question, dst AS id, min(pos) AS parent FROM h{k - 1} JOIN e ON src = id WHERE NOT EXISTS (SELECT 1 FROM r{k} x WHERE x.question = h{k - 1}.question AND x.id = dst) GROUP BY ALL)",
            f"n{k} AS (SELECT question, id, {k} AS hop, row_number() OVER (PARTITION BY question ORDER BY parent, id) AS pos FROM v{k})",
            f"h{k} AS (SELECT n{k}.* FROM n{k} JOIN t{k} USING (question) WHERE pos <= greatest({cap} - taken, 1))",
        ]
    return f"""WITH {_EDGES}, {', '.join(steps)}, o AS (SELECT question, id, hop, round(1.0::DOUBLE - 0.05::DOUBLE * hop, 9) AS score FROM ({' UNION ALL '.join(f'SELECT * FROM h{j}' for j in range(depth + 1))}))
SELECT question, id, hop::INT AS graph_distance, score AS graph_score, row_number() OVER (PARTITION BY question ORDER BY (hop <> 1)::INT, score DESC, hop, id)::INT AS rank FROM o"""


@query(_capped_sql(3, 15))
def bfs_capped(spark, d):
    return graph.ordered(graph.expand(_seeds(spark, d), _edges(spark, d), depth=3, max_expanded=15))


# -- fixtures of source code ---------------------------------------------------------------------------------------


@query(fixtures.values(fixtures.EXPECTED_INVERSION, "id, called_by"))
def graph_constructor_edges(spark, d):
    return graph.invert(fixtures.graph_chunks(spark)).select("id", F.array_join("called_by", ",").alias("called_by"))


@query(fixtures.values(fixtures.EXPECTED_NEIGHBOURS, "request, id, tier"))
def neighbour_resolution(spark, d):
    return graph.resolve(fixtures.neighbour_requests(spark), fixtures.graph_chunks(spark)).select("request", "id", "tier")


@query(fixtures.values(fixtures.EXPECTED_CHUNKS, "name, type, line_start, line_end, calls, complexity"))
def chunk_python(spark, d):
    made = chunks.chunk_python(fixtures.files(spark), "repo")
    return made.select("name", "type", "line_start", "line_end", F.array_join("calls", ",").alias("calls"), "complexity")


@query(fixtures.values(fixtures.EXPECTED_ORDER, "name, call_pos"))
def call_order(spark, d):
    rows = fixtures.graph_chunks(spark).withColumn("question", F.lit(1)).withColumn("rank", F.col("pos"))
    return graph.call_order(rows).select("name", "call_pos")


@query(fixtures.values(fixtures.EXPECTED_SYMBOLS, "symbol, name, same"))
def symbol_match(spark, d):
    return fixtures.symbol_pairs(spark).select("symbol", "name", text.same_symbol(F.col("symbol"), F.col("name")).alias("same"))


@query(fixtures.values(fixtures.EXPECTED_REWRITES, "question, summary, n_phrases, intent, direction, depth"))
def rewrite_normalise(spark, d):
    from tessera.plans.retrieval import normalise_rewrites

    out = normalise_rewrites(fixtures.rewrites(spark))
    return out.select("question", "summary", F.size("phrases").alias("n_phrases"), "intent", "direction", "depth")


# -- terms, context ------------------------------------------------------------------------------------------------

_IDENT = "regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')"


@query(f"SELECT item_id, list_sort(list_distinct(list_filter({_IDENT}, lambda w: NOT list_contains([{', '.join(repr(w) for w in text.TOPIC_STOP_WORDS)}], w)))) AS terms FROM benchmark")
def topic_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.topic_terms(F.col("text")).alias("terms"))


_STEM = "CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%es' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w END"


_TERMS = f"list_distinct(list_transform(regexp_extract_all(lower({{0}}), '[a-z_][a-z0-9_]*'), lambda w: {_STEM}))"


@query(f"""{_BM25}, x AS (SELECT question, doc AS id, {_TERMS.format('b.text')} AS qt, {_TERMS.format('o.text')} AS ht
  FROM h JOIN benchmark b ON item_id = question JOIN documents o ON doc_id = doc WHERE rank <= 20 AND score > 0)
SELECT question, id, round(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, ht)) / len(qt) END, 6) AS relevance FROM x""")
def relevance_score(spark, d):
    hits = _bm25_hits(spark, d).select("question", F.col("doc").alias("id"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), text.haystack_terms(F.col("text")).alias("q"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = hits.join(docs, "id").join(asked, "question")
    return found.select("question", "id", F.round(text.overlap(F.col("q"), text.haystack_terms(F.col("text"))), 6).alias("relevance"))


@query("""
WITH l AS (SELECT DISTINCT 's' || l_suppkey AS question, 'p' || l_partkey AS id, 1.0::DOUBLE / (1 + l_partkey % 9) AS score, 'c' || (l_partkey % 5) || '.m' || l_partkey AS name,
    ['m' || (l_partkey + 1), 'm' || (l_partkey + 200)] AS calls FROM lineitem),
o AS (SELECT question, list(name) AS names, list(split_part(name, '.', 2)) AS bare FROM l GROUP BY question),
s AS (SELECT a.question, a.id, coalesce(max(b.score), 0)::DOUBLE AS sibling FROM l a LEFT JOIN l b ON a.question = b.question AND a.id <> b.id AND split_part(a.name, '.', 1) = split_part(b.name, '.', 1) GROUP BY ALL)
SELECT question, id, len(list_filter(calls, lambda c: list_contains(names, c) OR list_contains(bare, c)))::INT AS connectivity, sibling AS sibling_score,
  round(score + least(len(list_filter(calls, lambda c: list_contains(names, c) OR list_contains(bare, c))), 4) * 0.05::DOUBLE + sibling * 0.15::DOUBLE, 9) AS priority
FROM l JOIN o USING (question) JOIN s USING (question, id)""")
def structural_priority(spark, d):
    k = F.col("l_partkey")
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("question"), F.concat(F.lit("p"), k.cast("string")).alias("id"), (F.lit(1.0) / (1 + k % 9)).alias("score"),
        F.concat(F.lit("c"), (k % 5).cast("string"), F.lit("."), name(k)).alias("name"), F.array(name(k + 1), name(k + 200)).alias("calls"),
    ).distinct().withColumn("called_by", F.array().cast("array<string>"))
    return context.with_priority(rows).select("question", "id", "connectivity", "sibling_score", F.round("priority", 9).alias("priority"))


@query()
def context_packing(spark, d):
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("question"), F.col("turn").alias("id"), F.col("role").alias("name"), F.lit("src/a.py").alias("file"), (F.lit(1.0) / (1 + F.col("turn"))).alias("score"),
        F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<string>").alias("calls"), F.array().cast("array<string>").alias("called_by"),
    )
    return context.select_context(rows).select("question", "id", "context_pos", F.length("text").alias("n_chars"))


@query("""
WITH q AS (SELECT p_partkey AS question, 'how does ' || p_name || ' relate to ' || p_brand AS text FROM part WHERE p_partkey % 100 = 0), s AS (SELECT DISTINCT p_name AS name FROM part)
SELECT question, name FROM q, s WHERE contains(lower(text), lower(name))""")
def explicit_symbols(spark, d):
    parts = table(spark, d, "part")
    asked = parts.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("question"), F.concat(F.lit("how does "), "p_name", F.lit(" relate to "), "p_brand").alias("text"))
    names = parts.select(F.col("p_name").alias("name")).distinct()
    return context.explicit_symbols(asked, names)


@query(f"WITH {_KNN.format('AND a.vec_id <> b.vec_id')}, q AS (SELECT vec_id AS question FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT question, max(round(score, 4)) AS top_score FROM kr WHERE rank <= 5 GROUP BY 1) SELECT question, top_score, coalesce(top_score, -1) < 0.4 AS low FROM q LEFT JOIN b USING (question)")
def low_confidence(spark, d):
    v = table(spark, d, "embeddings")
    hits = _vector_hits(spark, d, 6).where("question <> id")
    return context.low_confidence(hits, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question")), 0.4)


@query(f"""WITH {_KNN.format('')}, a AS (SELECT question, id FROM kr WHERE rank <= 20), s AS (SELECT question, id FROM kr WHERE rank <= 20 AND rank % 3 <> 0)
SELECT question, count(*) AS total, count(*) FILTER (s.id IS NULL) AS fresh, round(count(*) FILTER (s.id IS NULL) / count(*), 6) AS ratio, count(*) FILTER (s.id IS NULL) / count(*) < 0.2 AS exhausted
FROM a LEFT JOIN s USING (question, id) GROUP BY question""")
def gain_ratio(spark, d):
    hits = _vector_hits(spark, d)
    return context.gain(hits.select("question", "id"), hits.where("rank % 3 <> 0")).withColumn("ratio", F.round("ratio", 6))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    v = table(spark, d, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, length(substr(text, 1, 400))::INT AS cut_chars FROM documents")
def token_budget(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.token_count(t).alias("tokens"), F.length(text.cut_to_tokens(t, 100)).alias("cut_chars"))


# -- what answers show and cite, records, agent ----------------------------------------------------------------------


def _evidence(spark, d):
    """Turns of conversations as evidence: the conversation asks, a turn is a chunk that calls the next one."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("question"), F.col("turn").alias("id"), F.concat("role", F.col("turn").cast("string")).alias("name"), F.lit("method").alias("type"), F.concat(F.lit("src/"), "role").alias("file"),
        (F.lit(1.0) / (1 + F.col("turn"))).alias("score"), F.coalesce("text", F.lit("")).alias("raw_source"), F.col("turn").alias("retrieval_rank"),
        F.array(F.concat(F.when(F.col("role") == "user", "assistant").otherwise("user"), (F.col("turn") + 1).cast("string"))).alias("calls"), F.array().cast("array<string>").alias("called_by"),
    )


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id AS question, string_agg('[' || n || '] src/' || role || ' - ' || role || turn || chr(10) || substr(coalesce(text, ''), 1, 500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM r GROUP BY conv_id""")
def search_context(spark, d):
    return context.search_context(_evidence(spark, d))


@query("SELECT conv_id AS question, turn AS id, substr(coalesce(text, ''), 1, 300) AS shown FROM conversations")
def search_excerpts(spark, d):
    return context.excerpts(_evidence(spark, d)).select("question", "id", F.col("raw_source").alias("shown"))


@query("""SELECT conv_id AS question, string_agg('method ' || role || turn || ' in src/' || role || chr(10) || 'calls ' || CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END || (turn + 1) || chr(10) || 'called by ' || chr(10) ||
  substr(coalesce(text, ''), 1, 400), chr(10) || chr(10) ORDER BY turn) AS summary FROM conversations GROUP BY conv_id""")
def evidence_summary(spark, d):
    return context.evidence_summary(_evidence(spark, d))


@query("SELECT conv_id AS question, string_agg('- ' || role || turn || ' (src/' || role || ')', chr(10) ORDER BY role || turn, role) AS inventory FROM conversations GROUP BY conv_id")
def evidence_inventory(spark, d):
    return context.inventory(_evidence(spark, d))


@query("""WITH e AS (SELECT conv_id, turn, role || turn AS name, CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END || (turn + 1) AS callee FROM conversations)
SELECT conv_id AS question, count(*) FILTER (callee IN (SELECT name FROM e o WHERE o.conv_id = e.conv_id)) AS connected, count(*) FILTER (callee IN (SELECT name FROM e o WHERE o.conv_id = e.conv_id)) < 3 AS needs_more FROM e GROUP BY conv_id""")
def needs_more_context(spark, d):
    return agent.needs_more(_evidence(spark, d))


@query("""WITH r AS (SELECT conv_id, role || q AS symbol FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('user'), ('assistant')) v(role), (VALUES (0), (1), (5)) w(q))
SELECT conv_id AS question, 'Talk.' || symbol AS symbol FROM r WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = r.conv_id AND c.role || c.turn = r.symbol)""")
def unresolved_symbols(spark, d):
    named = F.transform(F.array(*[F.lit(f"{r}{q}") for r in ("user", "assistant") for q in (0, 1, 5)]), lambda x: F.concat(F.lit("Talk."), x))
    required = table(spark, d, "conversations").select(F.col("conv_id").alias("question")).distinct().select("question", F.explode(named).alias("symbol"))
    return agent.unresolved(required, _evidence(spark, d))


@query("""WITH x AS (SELECT conv_id, turn, role || turn AS name, turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id) AS named FROM conversations c)
SELECT conv_id AS question, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY NOT named, turn)::INT AS rank FROM x""")
def exact_symbol_prefix(spark, d):
    rows = _evidence(spark, d)
    last = rows.groupBy("question").agg(F.max_by("name", "id").alias("_n"), F.max("id").alias("_i"))
    queries = last.select("question", F.concat(F.lit("function "), "_n", F.lit("_"), F.col("question").cast("string")).alias("query"))
    unique = rows.withColumn("name", F.concat("name", F.lit("_"), F.col("question").cast("string"))).select("question", "id", "name", "score", (F.col("id") + 1).cast("int").alias("rank"))
    named = unique.drop("question", "rank", "score")
    return agent.exact_prefix(unique, named, queries).select("question", "id", "rank")


@query("""SELECT o_custkey AS repo_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey""")
def repo_records(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"))
    old, new = rows.where("updated_at.o_orderkey % 2 = 0"), rows
    return records.put(records.put(old.limit(0), old), new).select("repo_id", "status")


@query("SELECT event_id AS apply_id, user_id AS repo_id FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-15 00:00:00' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def pending_applies(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("apply_id"), F.col("user_id").alias("repo_id"), F.when(F.col("event_type") == "click", "pending_review").otherwise("done").alias("status"), F.col("ts").alias("expires_at"), "event_type")
    return records.pending(rows, rows.where("event_type = 'purchase'"), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("apply_id", "repo_id")


@query("""WITH s AS (SELECT user_id, max(ts) AS synced FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT event_id FROM events LEFT JOIN s USING (user_id) WHERE event_type <> 'click' AND (synced IS NULL OR ts > synced)""")
def answers_after_sync(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("user_id", "repo_id")
    return records.invalidated(rows.where("event_type <> 'click'").withColumnRenamed("ts", "written_at"), rows.where("event_type = 'click'").withColumnRenamed("ts", "synced_at")).select("event_id")


@query("SELECT n_nationkey AS question, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS body FROM nation")
def json_responses(spark, d):
    return records.as_json(table(spark, d, "nation").withColumnRenamed("n_nationkey", "question"))


@query(f"WITH {_LINKS} SELECT count(*) AS edges FROM (SELECT DISTINCT target, url FROM l)")
def graph_total_edges(spark, d):
    return graph.total_edges(QUERIES["call_graph_inversion"](spark, d)).select(F.col("edges").cast("long").alias("edges"))


@query("""WITH c AS (SELECT vec_id, j, avg(embedding[8 * i + j + 1]::DOUBLE) AS x FROM embeddings, range(8) a(i), range(8) b(j) WHERE (vec_id + i) % 3 <> 0 GROUP BY ALL),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM c GROUP BY vec_id) SELECT vec_id, j::INT AS i, round(x / greatest(n, 1e-9), 6) AS x FROM c JOIN n USING (vec_id)""")
def masked_mean_pool(spark, d):
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") + i) % 3 != 0, 1).otherwise(0))
    pooled = table(spark, d, "embeddings").select("vec_id", nearest.masked_mean(cells, mask).alias("v"))
    return pooled.select("vec_id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("WITH c AS (SELECT DISTINCT md5(text) AS m FROM documents WHERE doc_id % 2 = 0) SELECT count(*) AS chunks, count(DISTINCT source) AS files, count(*) FILTER (m IS NOT NULL) AS cached, count(*) FILTER (m IS NULL) AS fresh FROM documents LEFT JOIN c ON md5(text) = m")
def ingest_counters(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("file"), "text", "doc_id")
    return chunks.counted(docs, docs.where("doc_id % 2 = 0").select(F.md5("text").alias("text_md5")))


@query(fixtures.values(fixtures.EXPECTED_REPAIRS, "broken, repaired"))
def json_repair(spark, d):
    return fixtures.broken_json(spark).select("broken", text.repaired_json(F.col("broken")).alias("repaired"))


@query(fixtures.values(fixtures.EXPECTED_SYMBOL_WORDS, "question, symbol"))
def sole_symbol(spark, d):
    return fixtures.symbol_words(spark).select("question", F.coalesce(text.sole_symbol(F.col("question")), F.lit("-")).alias("symbol"))


def _repository(spark) -> retrieval.Repository:
    return retrieval.build(chunks.chunk_python(fixtures.files(spark), "repo"))


@query()
def retrieve_with_graph(spark, d):
    return retrieval.retrieve(_repository(spark), fixtures.asked(spark)).select("question", "name", "file", "score", "graph_distance")


@query()
def answers(spark, d):
    return retrieval.answers(_repository(spark), fixtures.asked(spark), lambda p: F.concat(F.lit("from "), F.length(p).cast("string"), F.lit(" characters"))).select("question", "answer", F.size("sources").alias("n_sources"))


@query()
def symbol_graph(spark, d):
    return retrieval.symbol_graph(_repository(spark), fixtures.SEED)[0].select("name", "file", "graph_distance", "is_entry")


@query()
def agentic_evidence(spark, d):
    return retrieval.agentic_evidence(_repository(spark), fixtures.asked(spark))[0].select("question", "name", "position")


@query()
def incremental_sync(spark, d):
    files = fixtures.files(spark)
    old = chunks.chunk_python(files, "repo")
    return retrieval.sync(old, files, files.withColumn("content", F.concat("content", F.lit("\n\ndef added(x):\n    return x\n"))), "repo").counters

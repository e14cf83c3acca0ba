"""BM25 over an inverted index held as DataFrames, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import PHRASE_STOP_WORDS, tokens
from tessera.session import ship

#: BM25's usual constants; a negative idf becomes this share of the mean idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Scores are ranked at this precision, so that sums in another order can't swap equal documents.
DECIMALS = 9
#: (question, term) rows that one pass over the postings carries (some 100 bytes each); more go in several passes.
ASKED = 1_000_000
#: Documents and questions that a task multiplies at once: with 2,000 terms of the questions 16 MB.
DOCUMENTS, QUESTIONS = 1000, 128


@dataclass(frozen=True)
class Index:
    """postings(doc, dl, term, tf) dealt by document, terms(term, df, idf) and the one-row totals(n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame

    def release(self) -> None:
        self.postings.unpersist()
        self.terms.unpersist()


def spread(docs: DataFrame, *keys: Column) -> DataFrame:
    """``docs`` dealt by ``keys`` to as many parts as the session shuffles to.

    One large file is read by one task otherwise; and what is grouped by document later stays in place. The number is
    given, because parts small in bytes would be merged again although tokens multiply them.
    """
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def build_index(docs: DataFrame, doc: Column, text: Column, name: Column | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> Index:
    """Index ``text`` with the document's name behind it.

    Texts are tokenised once. Postings are dealt by document and kept (``keep``: cached, or written as a table), so
    no later step shuffles them; term statistics are one aggregation with partial sums; the totals are single rows.
    """
    whole = text if name is None else F.concat_ws(" ", text, name)
    dealt = spread(docs.select(doc.alias("doc"), whole.alias("_text")), F.col("doc"))
    words = dealt.select("doc", tokens(F.col("_text")).alias("words")).withColumn("dl", F.size("words"))
    # The outer form, as a filter for empty lists would tokenise once more, before texts are dealt.
    postings = keep(words.select("doc", "dl", F.explode_outer("words").alias("term")).where("term is not null").groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    size = docs.agg(F.count(F.lit(1)).alias("n"))
    totals = size.crossJoin(postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_all"))).select("n", (F.col("_all") / F.col("n")).alias("avgdl"))
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size))
    raw = keep(counted.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, terms, totals)


def _best_in_part(asked: list[tuple[int, int, int]], n_questions: int, top_k: int):
    """A function over Arrow batches (doc, t, weight), sorted by doc: the best documents of every question among
    DOCUMENTS at a time. ``asked`` has (question, t, times)."""
    rows = np.array(sorted(asked), dtype=np.int64).reshape(-1, 3)
    blocks = []
    for begin in range(0, n_questions, QUESTIONS):
        some = rows[(rows[:, 0] >= begin) & (rows[:, 0] < begin + QUESTIONS)]
        terms, column = np.unique(some[:, 1], return_inverse=True)
        blocks.append((begin, terms, column, some[:, 0] - begin, some[:, 2].astype(float)))
    n_terms = int(rows[:, 1].max()) + 1 if len(rows) else 0

    def scored(docs: np.ndarray, t: np.ndarray, weight: np.ndarray):
        """(question, place in docs, score) of the best; docs holds each posting's document as a place."""
        at = np.full(n_terms, -1)
        for begin, terms, column, question, times in blocks:
            at[terms] = np.arange(len(terms))
            here = at[t]
            held = np.zeros((int(docs[-1]) + 1, len(terms)))
            held[docs[here >= 0], here[here >= 0]] = weight[here >= 0]
            at[terms] = -1
            wanted = np.zeros((len(terms), min(QUESTIONS, n_questions - begin)))
            wanted[column, question] = times
            score = np.round(held @ wanted, DECIMALS)
            for q in range(wanted.shape[1]):
                mine = score[:, q]
                hit = np.flatnonzero(mine > 0)
                hit = hit[np.argsort(-mine[hit], kind="stable")[:top_k]]
                yield np.full(len(hit), begin + q), hit, mine[hit]

    def run(batches):
        left: pa.Table | None = None
        for batch in _and_last(batches):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                left = more if left is None else pa.concat_tables([left, more])
            if left is None or not left.num_rows:
                continue
            left = left.combine_chunks()
            codes = left.column(0).combine_chunks().dictionary_encode() if left.num_rows else None
            place = codes.indices.to_numpy()
            # The last document may go on in the next batch.
            done = left.num_rows if batch is None else int(np.searchsorted(place, place[-1]))
            if batch is not None and place[-1] < DOCUMENTS:
                continue
            t, weight = (left.column(k).to_numpy()[:done] for k in (1, 2))
            begin = 0
            while begin < done:
                first = place[begin]
                end = min(done, int(np.searchsorted(place, first + DOCUMENTS)))
                found = list(scored(place[begin:end] - first, t[begin:end], weight[begin:end]))
                q, hit, score = (np.concatenate([f[k] for f in found]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), codes.dictionary.take(pa.array(hit + first)), pa.array(score)], names=["q", "doc", "score"])
                begin = end
            left = left.slice(done)

    return run


def _and_last(batches):
    yield from batches
    yield None


def search(index: Index, questions: DataFrame, question: Column, text: Column, top_k: int = 20) -> DataFrame:
    """(question, doc, rank, bm25_score): the best documents of each question, those without score left out.

    A token counts as often as the question has it. The questions are a stated set: their distinct terms go to the
    postings, where each task multiplies its documents' weights with the questions' and keeps the best of each; only
    those are shuffled. More than ASKED (question, term) rows go in several passes.
    """
    asked = questions.select(question.alias("question"), F.explode(tokens(text)).alias("term")).groupBy("question", "term").agg(F.count(F.lit(1)).alias("qtf"))
    passes = max(1, -(-asked.count() // ASKED))
    best = Window.partitionBy("question").orderBy(F.desc("score"), "doc")
    result = None
    for k in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("question"), F.lit(passes)) == k)
        found = _search(index, part, top_k)
        result = found if result is None else result.unionByName(found)
    ranked = result.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return ranked.select("question", "doc", "rank", F.round("score", 4).alias("bm25_score"))


def _search(index: Index, asked: DataFrame, top_k: int) -> DataFrame:
    """(question, doc, score): the best of each part of the postings."""
    spark = asked.sparkSession
    ship(spark)
    numbers: dict = {}
    terms: dict[str, int] = {}
    rows = [(numbers.setdefault(r.question, len(numbers)), terms.setdefault(r.term, len(terms)), r.qtf) for r in asked.collect()]  # ASKED at most
    known = F.broadcast(spark.createDataFrame(list(terms.items()), "term string, t int"))
    named = F.broadcast(spark.createDataFrame([(n, q) for q, n in numbers.items()], _numbered(asked)))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    idf = F.broadcast(index.terms.join(known, "term").select("term", "t", "idf"))
    met = index.postings.join(idf, "term").crossJoin(F.broadcast(index.totals)).select("doc", "t", weight.alias("weight"))
    kind = index.postings.schema["doc"].dataType.simpleString()
    hits = met.sortWithinPartitions("doc").mapInArrow(_best_in_part(rows, len(numbers), top_k), f"q int, doc {kind}, score double")
    return hits.join(named, "q").select("question", "doc", "score")


def _numbered(asked: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("q", T.IntegerType()), T.StructField("question", asked.schema["question"].dataType)])


def best_over_terms(index: Index, terms: DataFrame, question: Column, term: Column, top_k: int = 25) -> DataFrame:
    """(question, doc, rank, bm25_score): each search term is a query; a document keeps its best score."""
    each = terms.select(question.alias("question"), term.alias("term")).distinct()
    # A term of several questions is searched once.
    hits = search(index, each.select("term").distinct(), F.col("term"), F.col("term"), top_k).withColumnRenamed("question", "term")
    best = each.join(hits, "term").groupBy("question", "doc").agg(F.max("bm25_score").alias("bm25_score"))
    order = Window.partitionBy("question").orderBy(F.desc("bm25_score"), "doc")
    return best.withColumn("rank", F.row_number().over(order)).select("question", "doc", "rank", "bm25_score")


def expand_symbols(index: Index, names: DataFrame, phrases: DataFrame, top_symbols: int = 10, per_phrase: int = 5) -> DataFrame:
    """(question, pos, symbol): a question's phrases and the names of what they find, first occurrences in order.

    ``phrases`` has (question, pos, phrase), ``names`` (doc, name). Phrases that are stop-words go.
    """
    kept = phrases.withColumn("phrase", F.trim("phrase")).where((F.col("phrase") != "") & ~F.lower("phrase").isin(PHRASE_STOP_WORDS))
    hits = search(index, kept.select("phrase").distinct(), F.col("phrase"), F.col("phrase"), per_phrase).withColumnRenamed("question", "phrase")
    first = kept.join(hits, "phrase").groupBy("question", "doc").agg(F.min(F.struct("pos", "rank")).alias("at"))
    order = Window.partitionBy("question").orderBy("at")
    chosen = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top_symbols).join(names, "doc")
    both = kept.select("question", F.struct(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("n")).alias("at"), F.col("phrase").alias("symbol")).unionByName(
        chosen.select("question", F.struct(F.lit(1).alias("kind"), F.col("n").cast("long").alias("n")).alias("at"), F.col("name").alias("symbol"))
    )
    once = both.groupBy("question", "symbol").agg(F.min("at").alias("at"))
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("question").orderBy("at"))).select("question", "pos", "symbol")

"""Rank fusion and what follows it: payloads, preference for production code, exact names first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_production

#: The fusion constant and the weights of vector and keyword hits.
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60, 0.6, 0.4


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, top_k: int = 20, *, k: int = RRF_K, vector_weight: float = VECTOR_WEIGHT, keyword_weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """(question, id, rank, score): weighted reciprocal ranks summed; ties keep vector hits first, then their rank.

    Both inputs have (question, id, rank), ranks from 1.
    """
    lists = [
        hits.select("question", "id", F.lit(kind).alias("kind"), "rank", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"))
        for kind, (hits, w) in enumerate([(vector_hits, vector_weight), (keyword_hits, keyword_weight)])
    ]
    summed = lists[0].unionByName(lists[1]).groupBy("question", "id").agg(F.round(F.sum("part"), 12).alias("score"), F.min(F.struct("kind", "rank")).alias("at"))
    best = Window.partitionBy("question").orderBy(F.desc("score"), "at", "id")
    return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("question", "id", "rank", "score")


def concatenated(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two hit lists as one: the second list's ranks continue after the first, and an id in both stays twice."""
    length = first.groupBy("question").agg(F.max("rank").alias("_n"))
    after = second.join(length, "question", "left").withColumn("rank", F.col("rank") + F.coalesce("_n", F.lit(0))).drop("_n")
    return first.unionByName(after)


def with_payload(fused: DataFrame, chunks: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """The fused rows with their chunk's columns, the vector score (0 for lexical hits), and retrieval_rank from 0."""
    scores = vector_hits.groupBy("question", "id").agg(F.max("score").alias("_vector"))
    joined = fused.drop("score").join(scores, ["question", "id"], "left").join(chunks, "id")
    return joined.withColumn("score", F.coalesce("_vector", F.lit(0.0))).withColumn("retrieval_rank", F.col("rank") - 1).drop("_vector", "rank")


def prefer_production(rows: DataFrame, file: str = "file") -> DataFrame:
    """Drops tests and examples from the rows of a question, unless nothing else is left."""
    own = Window.partitionBy("question")
    marked = rows.withColumn("_p", is_production(F.col(file))).withColumn("_any", F.max("_p").over(own))
    return marked.where("_p or not _any").drop("_p", "_any")


def exact_first(rows: DataFrame, question_text: str = "question_text", name: str = "name") -> DataFrame:
    """A row named exactly as the question ranks before all others."""
    return rows.withColumn("retrieval_rank", F.when(F.lower(name) == F.lower(F.trim(question_text)), F.lit(-1)).otherwise(F.col("retrieval_rank")))

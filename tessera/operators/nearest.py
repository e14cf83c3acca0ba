"""Exact nearest neighbours by cosine similarity, for a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, norm

#: Question vectors that one pass holds: at 384 dimensions of 8 bytes some 12 MB.
BLOCK = 4096


def nearest(vectors: DataFrame, questions: DataFrame, top_k: int = 20, *, within: str | None = None, block: int = BLOCK) -> DataFrame:
    """(question, id, rank, score) of the ``top_k`` vectors nearest to each question.

    ``vectors`` has (id, vector), ``questions`` (question, vector), both also the column ``within`` where only
    vectors of the question's own value compete. The questions are a stated set: they go to the vectors in blocks
    of ``block``, each broadcast, so that a scan of the vectors is local and only the best k of each partition are
    shuffled. With ``within`` it is an equi-join. Ranks follow full precision; scores are rounded last.
    """
    held = vectors.withColumn("_n", norm(F.col("vector"))).where("_n > 0")
    asked = questions.select("question", *([within] if within else []), F.col("vector").alias("_q"), norm(F.col("vector")).alias("_qn")).where("_qn > 0")
    if within:
        met = held.join(asked, within)
        return _ranked(met, top_k)
    n = asked.count()
    result = None
    for k in range(max(1, -(-n // block))):
        part = asked if n <= block else asked.where(F.pmod(F.xxhash64("question"), F.lit(-(-n // block))) == k)
        found = _ranked(held.crossJoin(F.broadcast(part)), top_k)
        result = found if result is None else result.unionByName(found)
    return result


def _ranked(met: DataFrame, top_k: int) -> DataFrame:
    scored = met.select("question", "id", (dot(F.col("vector"), F.col("_q")) / (F.col("_n") * F.col("_qn"))).alias("score"))
    best = Window.partitionBy("question").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("question", "id", "rank", F.round("score", 4).alias("score"))


def masked_mean(cells: Column, mask: Column) -> Column:
    """The mean of token vectors (array of arrays) that the mask (array of 0 and 1) keeps, brought to length 1."""
    pairs = F.arrays_zip(cells.alias("v"), mask.alias("m"))
    kept = F.filter(pairs, lambda p: p["m"] > 0)
    total = F.aggregate(
        kept, F.transform(cells[0], lambda x: F.lit(0.0)), lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b.cast("double"))
    )
    mean = F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))
    length = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mean, lambda x: x / F.greatest(length, F.lit(1e-9)))


def mean_vectors(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """(group, vector): the mean of each group's vectors, brought to length 1."""
    cells = vectors.select(group, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return whole.select(group, F.transform("c", lambda c: c["x"] / F.greatest(F.col("n"), F.lit(1e-9))).alias("vector"))

"""Retrieval metrics over ranks, latency percentiles and the golden set."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship


def recall_at(rank: Column, k: int) -> Column:
    """Share of questions whose rank is at most ``k``; a null rank was not found."""
    return F.round(F.coalesce(F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))), F.lit(0.0)), 4)


def mean_reciprocal_rank(rank: Column) -> Column:
    return F.round(F.coalesce(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), F.lit(0.0)), 4)


def ndcg_at(rank: Column, k: int) -> Column:
    """One relevant row for each question."""
    return F.round(F.coalesce(F.avg(F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)), F.lit(0.0)), 4)


def summary(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    r = F.col(rank)
    return ranks.agg(
        F.count(F.lit(1)).alias("questions"), recall_at(r, 1).alias("recall_at_1"), recall_at(r, 5).alias("recall_at_5"), recall_at(r, 10).alias("recall_at_10"),
        mean_reciprocal_rank(r).alias("mrr"), ndcg_at(r, 5).alias("ndcg_at_5"), ndcg_at(r, 10).alias("ndcg_at_10"),
    )


def recall_per_file(ranks: DataFrame, file: str = "file", k: int = 5, worst: int | None = None) -> DataFrame:
    """(file, recall, questions), worst first; ``worst`` bounds the report."""
    out = ranks.groupBy(file).agg(recall_at(F.col("rank"), k).alias("recall"), F.count(F.lit(1)).alias("questions")).orderBy("recall", file)
    return out if worst is None else out.limit(worst)


def percentiles(values: DataFrame, value: str, group: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles at the half-even rounded place p/100*(n-1) of each group's sorted values.

    Equal values are counted first, so a group of any size is its distinct values with running counts.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(group).orderBy(value)
    placed = counted.withColumn("to", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    at = lambda p: F.bround(F.lit(p / 100.0) * (F.col("n") - 1), 0) + 1
    return placed.groupBy(group).agg(*[F.round(F.min(F.when(F.col("to") >= at(p), F.col(value))), 1).alias(f"p{p}") for p in points])


def golden_set(chunks: DataFrame, limit: int = 100, least: int = 15) -> DataFrame:
    """(question, expected_id, file, name) for chunks with a docstring worth asking about, in the order of ids."""
    described = chunks.where(F.length("docstring") >= least).orderBy("id").limit(limit)
    return described.select(F.format_string("What does %s do?", "name").alias("question"), F.col("id").alias("expected_id"), "file", "name")


#: Characters of items that one automaton holds (some 100 bytes each); more go in several passes over the texts.
AUTOMATON = 1 << 20


def containing(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without their text, once for each item (question, text) that their text contains.

    The items are a stated set, told to every task as one automaton that reads a text once.
    """
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // AUTOMATON))
    result = None
    for k in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k)
        found = _containing(docs, items.schema["question"].dataType.simpleString(), [(r.question, r.text) for r in some.select("question", "text").collect()], text)
        result = found if result is None else result.unionByName(found)
    return result


def _containing(docs: DataFrame, kind: str, items: list[tuple], text: str) -> DataFrame:
    held: dict[str, list] = {}
    for question, wanted in items:
        if wanted is not None:
            held.setdefault(wanted, []).append(question)
    rest = [c for c in docs.columns if c != text]
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    made = to_arrow_type(StructType.fromDDL(f"question {kind}")["question"].dataType)

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for wanted, questions in held.items():
            if wanted:
                machine.add_word(wanted, questions)
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            row, question = [], []
            for k, t in enumerate(batch.column(len(rest)).to_pylist()):
                found = {id(questions): questions for _, questions in machine.iter(t)} if t is not None and len(machine) else {}
                met = [q for questions in found.values() for q in questions] + (held.get("", []) if t is not None else [])
                row += [k] * len(met)
                question += met
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(question, made), *(batch.column(i).take(at) for i in range(len(rest)))], names=["question", *rest])

    ship(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, text).mapInArrow(run, f"question {kind}, {kinds}")


def ranks_of(expected: DataFrame, fused: DataFrame) -> DataFrame:
    """Each expected row with its rank in the fused list, null where it isn't there."""
    return expected.join(fused.select("question", F.col("id").alias("expected_id"), "rank"), ["question", "expected_id"], "left")

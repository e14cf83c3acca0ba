"""The iterative retriever: a deterministic decider over a state that is one frame for all questions.

Each hop is one plan for all open questions: decide, retrieve or expand, merge the evidence. The decider is
replaceable; the default stops when the evidence covers the question, expands a connected symbol that isn't
expanded yet, else retrieves again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

#: Hops at most; retrieval sizes shrink from 20 by 6 a hop, to 4 at least; evidence kept.
HOPS, FIRST, STEP, LEAST, EVIDENCE = 6, 20, 6, 4, 30


def retrieval_size(hop: int) -> int:
    return max(LEAST, FIRST - STEP * hop)


def covered(question: Column, haystack: Column) -> Column:
    """All entity terms of the question are in the evidence, or half of its topic terms are."""
    entities, topics = text.entity_terms(question), F.transform(text.topic_terms(question), text.stem)
    held = text.haystack_terms(haystack)
    all_entities = (F.size(entities) > 0) & (F.size(F.array_except(entities, held)) == 0)
    half = (F.size(topics) > 0) & (F.size(F.array_intersect(topics, held)) * 2 >= F.size(topics))
    return all_entities | half


def query_symbol(query: Column) -> Column:
    """The symbol that a retrieval query names (function X, class X, subclass of X), null for free text."""
    found = F.regexp_extract(F.trim(query), r"^(?:function|method|class|subclass of)\s+([A-Za-z_][\w.]*)$", 1)
    return F.when(found != "", found)


def sufficient(state: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question, enough, connected): coverage by the evidence's names, files and sources, and its linked symbols."""
    whole = evidence.groupBy("question").agg(
        F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "name", "file", "raw_source"))).alias("haystack"), F.collect_set("name").alias("names"),
        F.flatten(F.collect_list(F.concat("calls", "called_by"))).alias("near"),
    )
    joined = state.join(whole, "question", "left")
    connected = F.size(F.array_intersect(F.array_distinct(F.coalesce("near", F.array().cast("array<string>"))), F.coalesce("names", F.array().cast("array<string>"))))
    return joined.select("question", F.coalesce(covered(F.col("question_text"), F.coalesce("haystack", F.lit(""))), F.lit(False)).alias("enough"), connected.alias("connected"))


def next_symbol(state: DataFrame, evidence: DataFrame, expanded: DataFrame) -> DataFrame:
    """(question, symbol): the evidence's most promising symbol that wasn't expanded yet.

    Candidates are chunks, no classes, with a neighbour outside the evidence; ordered by what share of the
    question's terms they hold, their degree, score and name.
    """
    names = evidence.groupBy("question").agg(F.collect_set("name").alias("_names"))
    near = F.array_distinct(F.concat("calls", "called_by"))
    open_ = evidence.join(names, "question").withColumn("_new", F.size(F.array_except(near, F.col("_names")))).where("_new > 0 and type <> 'class'")
    left = open_.join(expanded.select("question", F.col("symbol").alias("name")), ["question", "name"], "left_anti").join(state.select("question", "question_text"), "question")
    fit = text.overlap(text.haystack_terms(F.col("question_text")), text.haystack_terms(F.concat_ws(" ", "name", "raw_source")))
    best = Window.partitionBy("question").orderBy(F.desc("_fit"), F.desc("_degree"), F.desc("score"), "name")
    ranked = left.withColumn("_fit", F.round(fit, 6)).withColumn("_degree", F.size(near)).withColumn("_n", F.row_number().over(best))
    return ranked.where("_n = 1").select("question", F.col("name").alias("symbol"))


def merge_evidence(old: DataFrame, new: DataFrame, keep: int = EVIDENCE) -> DataFrame:
    """Union by (question, id): the newer payload at the older one's position; the first ``keep`` by score stay.

    Rows may carry ``position``; those without get one by score, new ones after the old.
    """
    def placed(rows: DataFrame, late: int) -> DataFrame:
        if "position" not in rows.columns:
            rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id")))
        return rows.withColumn("_new", F.lit(late))

    both = placed(old, 0).unionByName(placed(new, 1))
    newest = Window.partitionBy("question", "id")
    once = both.withColumn("_first", F.min(F.struct("_new", "position")).over(newest)).withColumn("_k", F.row_number().over(newest.orderBy(F.desc("_new"), "position"))).where("_k = 1")
    best = Window.partitionBy("question").orderBy(F.desc("score"), "_first", "id")
    kept = once.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= keep)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("question").orderBy("_first", "id"))).drop("_k", "_new", "_first")


def exact_prefix(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of each question with the chunks named exactly as its query's symbol put first, none twice.

    ``queries`` has (question, query); ``hits`` (question, id, rank, score) and the chunks' columns.
    """
    asked = queries.select("question", query_symbol(F.col("query")).alias("name")).where("name is not null")
    exact = chunks.join(asked, "name").withColumn("score", F.lit(1.0)).withColumn("_at", F.struct(F.lit(0).alias("late"), F.col("id").cast("string").alias("by")))
    rest = hits.join(exact.select("question", "id"), ["question", "id"], "left_anti").withColumn("_at", F.struct(F.lit(1).alias("late"), F.lpad(F.col("rank").cast("string"), 12, "0").alias("by")))
    columns = [c for c in hits.columns if c != "rank"]
    both = exact.select(*columns, "_at").unionByName(rest.select(*columns, "_at"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("_at"))).drop("_at")


def needs_more(evidence: DataFrame, least: int = 3) -> DataFrame:
    """(question, connected, needs_more): fewer than ``least`` pieces of evidence that call or are called by another one."""
    names = evidence.select("question", F.col("name").alias("_n")).distinct()
    near = evidence.select("question", "id", F.explode_outer(F.array_distinct(F.concat("calls", "called_by"))).alias("_n"))
    linked = near.join(names, ["question", "_n"], "left_semi").select("question", "id").distinct().groupBy("question").agg(F.count(F.lit(1)).alias("connected"))
    counted = evidence.select("question").distinct().join(linked, "question", "left").withColumn("connected", F.coalesce("connected", F.lit(0)))
    return counted.withColumn("needs_more", F.col("connected") < least)


def unresolved(required: DataFrame, evidence: DataFrame) -> DataFrame:
    """Required symbols (question, symbol) that no name of the question's evidence stands for, whole or by their last parts."""
    last = lambda c: text.bare_name(F.col(c))
    known = evidence.select("question", F.explode(F.array("name", last("name"))).alias("_k")).distinct()
    asked = required.where("trim(symbol) <> ''").select("question", "symbol", F.explode(F.array_distinct(F.array("symbol", last("symbol")))).alias("_k"))
    met = asked.join(known, ["question", "_k"]).select("question", "symbol").distinct()
    return required.where("trim(symbol) <> ''").join(met, ["question", "symbol"], "left_anti").distinct()


def expansion_flags(evidence: DataFrame, state: DataFrame) -> DataFrame:
    """Evidence with ``redundant`` (all neighbours are known already) and ``low_value`` (a class, an abstract body,
    or no term of the question in name or source).

    ``evidence`` has abstract, as chunks.with_implementation_flags() gives it.
    """
    names = evidence.groupBy("question").agg(F.flatten(F.collect_list(F.array("name", text.bare_name(F.col("name"))))).alias("_names"))
    joined = evidence.join(names, "question").join(state.select("question", "question_text"), "question")
    near = F.array_distinct(F.concat("calls", "called_by"))
    fit = text.overlap(text.haystack_terms(F.col("question_text")), text.haystack_terms(F.concat_ws(" ", "name", "raw_source")))
    return joined.withColumn("redundant", F.size(F.array_except(near, "_names")) == 0).withColumn("low_value", (F.col("type") == "class") | F.col("abstract") | (fit == 0)).drop("_names", "question_text")


def next_hop(state: DataFrame, evidence: DataFrame, expanded: DataFrame) -> DataFrame:
    """(question, symbol): where an execution path goes on, given what was expanded (question, symbol, hop).

    Of the chunks that weren't expanded, those neither redundant nor of low value come first; then those that the
    symbol expanded last calls, in the order of its calls; then by the share of the question's terms they have, degree,
    being runtime code, and score. Needs abstract and runtime.
    """
    flagged = expansion_flags(evidence, state).join(expanded.select("question", F.col("symbol").alias("name")), ["question", "name"], "left_anti")
    last = expanded.groupBy("question").agg(F.max_by("symbol", "hop").alias("name")).join(evidence.select("question", "name", F.col("calls").alias("_calls")), ["question", "name"]).select("question", "_calls")
    asked = flagged.join(last, "question", "left").join(state.select("question", "question_text"), "question")
    called = F.array_position(F.coalesce("_calls", F.array().cast("array<string>")), text.bare_name(F.col("name"))).cast("int")
    fit = F.round(text.overlap(text.haystack_terms(F.col("question_text")), text.haystack_terms(F.concat_ws(" ", "name", "raw_source"))), 6)
    order = [
        (F.col("redundant") | F.col("low_value")).cast("int"), F.when(called > 0, 0).otherwise(1), F.when((called > 0) & (fit > 0), 0).otherwise(1), called,
        F.desc(fit), F.desc(F.size(F.array_distinct(F.concat("calls", "called_by")))), F.desc("runtime"), F.desc("score"), F.col("name"),
    ]
    return asked.withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy(*order))).where("_n = 1").select("question", F.col("name").alias("symbol"))


def preferred_action(decisions: DataFrame, state: DataFrame, evidence: DataFrame, expanded: DataFrame) -> DataFrame:
    """Decisions (question, action, action_input, required array) after the policy gates, with ``gate``, the first that changed it.

    A query without searchable words, a repeated one, or one for a symbol that is known already becomes an expansion of the
    next hop; an expansion of an unknown, abstract or expanded symbol moves to the next hop or, where there is none, to a
    retrieval of what is required; an answer before required symbols are found becomes their retrieval.
    """
    hop = next_hop(state, evidence, expanded).withColumnRenamed("symbol", "_next")
    missing = unresolved(decisions.select("question", F.explode("required").alias("symbol")), evidence).groupBy("question").agg(F.min("symbol").alias("_missing"))
    known = evidence.groupBy("question").agg(F.collect_set("name").alias("_names"), F.collect_set(F.when(F.col("abstract"), F.col("name"))).alias("_abstract"))
    done = expanded.groupBy("question").agg(F.collect_set("symbol").alias("_done"))
    joined = decisions.join(known, "question", "left").join(done, "question", "left").join(hop, "question", "left").join(missing, "question", "left")
    none = F.array().cast("array<string>")
    has = lambda c, v: F.array_contains(F.coalesce(F.col(c), none), v)
    act, at = F.col("action"), F.col("action_input")
    gate = (
        F.when((act == "retrieve") & (F.size(text.agent_phrases(at)) == 0), "bad_query")
        .when((act == "retrieve") & has("_names", query_symbol(at)), "known_symbol")
        .when((act == "expand_graph") & ~has("_names", at), "unresolved_symbol")
        .when((act == "expand_graph") & has("_abstract", at), "abstract")
        .when((act == "expand_graph") & has("_done", at), "already_expanded")
        .when((act == "answer") & F.col("_missing").isNotNull(), "missing_information")
    )
    moved = joined.withColumn("gate", gate)
    ask = F.concat(F.lit("function "), "_missing")
    goes = F.when(F.col("gate") == "missing_information", F.struct(F.lit("retrieve").alias("a"), ask.alias("i"))).when(
        F.col("_next").isNotNull(), F.struct(F.lit("expand_graph").alias("a"), F.col("_next").alias("i"))
    ).when(F.col("_missing").isNotNull(), F.struct(F.lit("retrieve").alias("a"), ask.alias("i"))).otherwise(F.struct(F.lit("answer").alias("a"), F.lit("").alias("i")))
    chosen = F.when(F.col("gate").isNull(), F.struct(act.alias("a"), at.alias("i"))).otherwise(goes)
    return moved.withColumn("_c", chosen).select("question", F.col("_c.a").alias("action"), F.col("_c.i").alias("action_input"), "required", "gate")


def run(
    questions: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], expand: Callable[[DataFrame], DataFrame], keep_state: Callable[[DataFrame], DataFrame], hops: int = HOPS
) -> tuple[DataFrame, DataFrame]:
    """(evidence, trace) for (question, question_text).

    ``retrieve(questions, size)`` and ``expand((question, symbol))`` return evidence rows; ``keep_state`` cuts a
    frame's lineage (a written table or checkpoint), once a hop. The trace has (question, hop, action, symbol).
    """
    evidence = keep_state(retrieve(questions, retrieval_size(0)))
    trace = questions.select("question", F.lit(0).alias("hop"), F.lit("retrieve").alias("action"), F.lit(None).cast("string").alias("symbol"))
    expanded = trace.where("action = 'expand'").select("question", "symbol")
    open_ = questions
    for hop in range(1, hops):
        verdict = sufficient(open_, evidence)
        open_ = keep_state(open_.join(verdict.where("not enough").select("question"), "question", "left_semi"))
        if open_.isEmpty():
            break
        chosen = keep_state(next_symbol(open_, evidence.join(open_.select("question"), "question", "left_semi"), expanded))
        again = open_.join(chosen.select("question"), "question", "left_anti")
        new = expand(chosen).unionByName(retrieve(again, retrieval_size(hop)))
        step = chosen.select("question", F.lit(hop).alias("hop"), F.lit("expand").alias("action"), "symbol").unionByName(
            again.select("question", F.lit(hop).alias("hop"), F.lit("retrieve").alias("action"), F.lit(None).cast("string").alias("symbol"))
        )
        trace = keep_state(trace.unionByName(step))
        expanded = trace.where("action = 'expand'").select("question", "symbol")
        grown = keep_state(merge_evidence(evidence, new))
        # A question whose evidence didn't grow is exhausted.
        more = grown.groupBy("question").count().join(evidence.groupBy("question").agg(F.count(F.lit(1)).alias("_was")), "question").where("count > _was")
        open_ = open_.join(more.select("question"), "question", "left_semi")
        evidence = grown
    return evidence, trace

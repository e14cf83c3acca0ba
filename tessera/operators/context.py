"""Choosing and fitting chunks into a prompt's budget, and the text around them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import bare_name, owner
from tessera.operators.fusion import prefer_production
from tessera.session import ship

#: Tokens of the whole prompt, of its fixed parts, of a chunk's labels; the least code worth sending;
#: the share of the budget that one chunk may take at first.
MAX_TOKENS, SYSTEM_TOKENS, USER_TOKENS, LABEL_TOKENS, LEAST_TOKENS, SHARE = 2500, 320, 63, 61, 40, 0.5


def with_priority(rows: DataFrame, named: Column | None = None) -> DataFrame:
    """Adds connectivity, sibling_score and priority to each question's candidates (question, id, name, calls, called_by, score), an id once a question.

    priority = score + 0.05 for each neighbour among the candidates, four at most, + 0.15 of the best score of
    another member of the same class, + 1 where ``named`` holds.
    """
    near = F.concat(F.coalesce("calls", F.array().cast("array<string>")), F.coalesce("called_by", F.array().cast("array<string>")))
    names = rows.select("question", F.explode(F.array("name", bare_name(F.col("name")))).alias("_near")).distinct()
    linked = rows.select("question", "id", F.explode(near).alias("_near")).join(names, ["question", "_near"], "left_semi").groupBy("question", "id").agg(F.count(F.lit(1)).cast("int").alias("connectivity"))
    owned = rows.join(linked, ["question", "id"], "left").withColumn("connectivity", F.coalesce("connectivity", F.lit(0))).withColumn("_owner", owner(F.col("name")))
    owned = owned.select(*rows.columns, "connectivity", "_owner")
    # The best score of the others: the second best for the row that is itself the best.
    by_score = Window.partitionBy("question", "_owner").orderBy(F.desc("score"), "id")
    class_ = Window.partitionBy("question", "_owner")
    placed = owned.withColumn("_place", F.row_number().over(by_score))
    placed = placed.withColumn("_first", F.max(F.when(F.col("_place") == 1, F.col("score"))).over(class_)).withColumn("_second", F.max(F.when(F.col("_place") == 2, F.col("score"))).over(class_))
    sibling = F.when(F.col("_owner").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.when(F.col("_place") == 1, F.col("_second")).otherwise(F.col("_first")), F.lit(0.0)))
    out = placed.withColumn("sibling_score", sibling.cast("double"))
    extra = F.when(named, F.lit(1.0)).otherwise(F.lit(0.0)) if named is not None else F.lit(0.0)
    priority = F.col("score") + F.least("connectivity", F.lit(4)) * 0.05 + F.col("sibling_score") * 0.15 + extra
    return out.withColumn("priority", priority).drop("_owner", "_place", "_first", "_second")


def fit(texts: list[str], max_tokens: int = MAX_TOKENS) -> list[tuple[int, str]]:
    """(position, text) of what fits: texts in order of priority, cut where they don't fit whole.

    A text takes what is left or half of the budget, whichever is less; one of which fewer than LEAST_TOKENS
    would remain is left out; at the end, texts that only their share cut short get what is left over.
    """
    count = lambda t: max(1, len(t) // 4)
    budget = max(0, max_tokens - SYSTEM_TOKENS - USER_TOKENS)
    share = max(LEAST_TOKENS, int(budget * SHARE))
    used, out, short = 0, [], []
    for k, text in enumerate(texts):
        left = budget - used
        room = min(left, share)
        need = count(text) + LABEL_TOKENS
        if need <= room:
            out.append((k, text))
            used += need
            continue
        code = room - LABEL_TOKENS
        if code < LEAST_TOKENS:
            continue
        out.append((k, text[: code * 4]))
        used += count(out[-1][1]) + LABEL_TOKENS
        if share < left:
            short.append(len(out) - 1)
    for at in short:
        spare = budget - used
        if spare < LEAST_TOKENS:
            break
        k, now = out[at]
        more = min(spare, count(texts[k]) - count(now))
        if more > 0:
            longer = texts[k][: (count(now) + more) * 4]
            used += count(longer) - count(now)
            out[at] = (k, longer)
    return out


def select_context(rows: DataFrame, max_tokens: int = MAX_TOKENS, named: Column | None = None) -> DataFrame:
    """The candidates of each question that fit its prompt, with ``text`` cut to fit and ``context_pos``.

    Production code is preferred, then structural priority decides; where a question names symbols, those come
    first and the plain score decides. Each step depends on what was cut before it, so one question's candidates
    (35 at most after retrieval) are fitted together.
    """
    kept = with_priority(prefer_production(rows), named).withColumn("_named", named if named is not None else F.lit(False))
    any_named = F.max("_named").over(Window.partitionBy("question"))
    order = F.when(any_named, F.struct(F.col("_named").cast("double").alias("a"), F.col("score").alias("b"), F.col("priority").alias("c"))).otherwise(
        F.struct(F.lit(0.0).alias("a"), F.col("priority").alias("b"), F.lit(0.0).alias("c"))
    )
    placed = kept.withColumn("_order", order).withColumn("context_pos", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("_order"), "id")) - 1).drop("_order", "_named")

    schema = T.StructType([T.StructField(f.name, T.IntegerType()) if f.name == "context_pos" else f for f in placed.schema.fields])
    laid = placed.repartition("question").sortWithinPartitions("question", "context_pos")
    text_at, pos_at, question_at = (schema.names.index(c) for c in ("text", "context_pos", "question"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in _and_last(batches):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                left = more if left is None else pa.concat_tables([left, more])
            if left is None or not left.num_rows:
                continue
            asked, texts = left.column(question_at).to_pylist(), left.column(text_at).to_pylist()
            # The last question may go on in the next batch.
            end = len(asked) if batch is None else next((k for k in range(len(asked) - 1, 0, -1) if asked[k - 1] != asked[-1]), 0)
            row, cut, place, begin = [], [], [], 0
            for k in range(1, end + 1):
                if k == end or asked[k] != asked[begin]:
                    chosen = fit([t or "" for t in texts[begin:k]], max_tokens)
                    row += [begin + n for n, _ in chosen]
                    cut += [t for _, t in chosen]
                    place += range(len(chosen))
                    begin = k
            out = left.take(pa.array(row, pa.int64()))
            out = out.set_column(text_at, "text", pa.array(cut, out.schema.field(text_at).type)).set_column(pos_at, "context_pos", pa.array(place, pa.int32()))
            yield from out.combine_chunks().to_batches()
            left = left.slice(end)

    ship(rows.sparkSession)
    return laid.mapInArrow(fitted, schema)


def _and_last(batches):
    yield from batches
    yield None


def explicit_symbols(questions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(question, name): symbols that a question's text names, without those that a longer named one begins with.

    ``questions`` has (question, text), ``symbols`` (name), or (question, name) for a question's own candidates. Names meet the
    questions' substrings of their lengths by an equi-join, so no name is compared with every question.
    """
    own = ["question"] if "question" in symbols.columns else []
    names = symbols.select(*own, "name", F.lower("name").alias("_part")).where("_part <> ''").distinct()
    lengths = names.agg(F.collect_set(F.length("_part")).alias("n"))
    asked = questions.select("question", F.lower("text").alias("_t")).crossJoin(F.broadcast(lengths))
    places = asked.select("question", "_t", F.explode("n").alias("n")).where(F.length("_t") >= F.col("n"))
    parts = places.select("question", F.explode(F.transform(F.sequence(F.lit(1), F.length("_t") - F.col("n") + 1), lambda i: F.substring("_t", i, F.col("n")))).alias("_part")).distinct()
    held = parts.join(names, [*own, "_part"]).select("question", "name").distinct()
    longer = held.select("question", F.split(F.lower("name"), r"\.").alias("_p")).where(F.size("_p") > 1)
    inside = longer.select("question", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.array_join(F.slice("_p", 1, i), "."))).alias("_start")).distinct()
    return held.withColumn("_start", F.lower("name")).join(inside, ["question", "_start"], "left_anti").select("question", "name")


def chunk_block() -> Column:
    """The prompt's block for one chunk: labels, then code."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit("(none)"))
    return F.concat_ws(
        "\n", F.format_string("Symbol %d", F.col("context_pos") + 1), F.concat(F.lit("Type: "), "type"), F.concat(F.lit("Name: "), "name"), F.concat(F.lit("File: "), "file"),
        F.concat(F.lit("Calls: "), listed("calls")), F.concat(F.lit("Called by: "), listed("called_by")), F.lit("Code:"), F.col("text"),
    )


#: What the answer is to do, by intent; the null row holds for all others.
INSTRUCTIONS = (
    ("understand_flow", "Walk through the calls in the order in which they run, from the entry to the result."),
    ("find_usage", "List each place that uses the symbol and say what it uses it for."),
    ("debug", "Name the likely cause, the lines that show it, and a fix."),
    ("explain_concept", "Explain the idea first, then how the code below realises it."),
    ("find_function", "Name the function that does it and its file, then say how it works."),
    (None, "Answer from the code below."),
)


def prompts(context: DataFrame, instructions: DataFrame | None = None) -> DataFrame:
    """(question, prompt): instruction by intent, the chunks' blocks in order, the question.

    ``context`` has question, intent, question_text and the chunks' columns; ``instructions`` (intent, instruction), a
    handful of rows.
    """
    table = context.sparkSession.createDataFrame(list(INSTRUCTIONS), "intent string, instruction string") if instructions is None else instructions
    default = table.where("intent is null").select(F.col("instruction").alias("_any"))
    blocks = context.groupBy("question", "intent", "question_text").agg(F.sort_array(F.collect_list(F.struct("context_pos", chunk_block().alias("b")))).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n---\n\n")
    told = blocks.join(F.broadcast(table.where("intent is not null")), "intent", "left").join(F.broadcast(default), F.lit(True), "left")
    return told.select("question", F.concat_ws("\n\n", F.coalesce("instruction", "_any", F.lit("Answer from the code below.")), body, F.concat(F.lit("Question: "), "question_text")).alias("prompt"))


def sources(rows: DataFrame) -> DataFrame:
    """(question, rank, name, file, type, line_start, score): what an answer cites; the reranker's score where there is one."""
    score = F.coalesce("rerank_score", "score") if "rerank_score" in rows.columns else F.col("score")
    return rows.select("question", "rank", "name", "file", "type", "line_start", score.alias("score"))


def excerpts(rows: DataFrame, chars: int = 300) -> DataFrame:
    """Search results as they are shown: the first characters of each source."""
    return rows.withColumn("raw_source", F.substring("raw_source", 1, chars))


def search_context(rows: DataFrame, chars: int = 500) -> DataFrame:
    """(question, context): numbered blocks of the hits' first characters, in their order."""
    block = F.concat(F.lit("["), F.col("retrieval_rank").cast("string"), F.lit("] "), "file", F.lit(" - "), "name", F.lit("\n"), F.substring("raw_source", 1, chars))
    place = Window.partitionBy("question").orderBy("retrieval_rank", "id")
    placed = rows.withColumn("retrieval_rank", F.row_number().over(place))
    listed = placed.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("retrieval_rank", block.alias("b")))).alias("l"))
    return listed.select("question", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def evidence_summary(rows: DataFrame, calls: int = 5, chars: int = 400) -> DataFrame:
    """(question, summary): each piece of evidence with some calls and callers and the first of its source."""
    some = lambda c: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, calls), ", ")
    line = F.concat_ws("\n", F.concat("type", F.lit(" "), "name", F.lit(" in "), "file"), F.concat(F.lit("calls "), some("calls")), F.concat(F.lit("called by "), some("called_by")), F.substring("raw_source", 1, chars))
    listed = rows.groupBy("question").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("b")))).alias("l"))
    return listed.select("question", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("summary"))


def inventory(rows: DataFrame) -> DataFrame:
    """(question, inventory): a line for each piece of evidence."""
    listed = rows.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("name", "file"))).alias("l"))
    return listed.select("question", F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["name"], F.lit(" ("), x["file"], F.lit(")"))), "\n").alias("inventory"))


def diff_prompt(context: DataFrame, request: Column) -> DataFrame:
    """(question, prompt): the code of the context and a request for a change, to be answered as JSON."""
    listed = context.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("context_pos", chunk_block().alias("b")))).alias("l"), F.any_value(request).alias("r"))
    body = F.array_join(F.transform("l", lambda x: x["b"]), "\n\n---\n\n")
    return listed.select("question", F.concat_ws("\n\n", body, F.concat(F.lit("Change: "), "r"), F.lit('Answer with one JSON object: {"explanation": ..., "diff": a unified diff}.')).alias("prompt"))


def nearest_misses(rows: DataFrame, low: DataFrame, n: int = 3) -> DataFrame:
    """(question, answer, top): what a question without confident hits is told: the best few names, files and scores."""
    best = Window.partitionBy("question").orderBy(F.desc("score"), "id")
    some = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n).groupBy("question").agg(F.sort_array(F.collect_list(F.struct("_n", "name", "file", "score"))).alias("l"))
    told = low.where("low").select("question").join(some, "question", "left")
    kind = "array<struct<name:string,file:string,score:double>>"
    top = F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["file"].alias("file"), x["score"].cast("double").alias("score")))
    return told.select("question", F.lit("No code in this repository answers that with confidence.").alias("answer"), F.coalesce(top, F.array().cast(kind)).alias("top"))


def low_confidence(hits: DataFrame, questions: DataFrame, least: float = 0.05, score: str = "score") -> DataFrame:
    """(question, top_score, low): true where nothing was found or the best score is under ``least``."""
    top = hits.groupBy("question").agg(F.max(score).alias("top_score"))
    return questions.select("question").join(top, "question", "left").withColumn("low", F.coalesce("top_score", F.lit(-1.0)) < least)


def gain(new: DataFrame, seen: DataFrame, least: float = 0.2) -> DataFrame:
    """(question, total, fresh, ratio, exhausted): how much of a retrieval is new."""
    marked = new.join(seen.select("question", "id").distinct().withColumn("_seen", F.lit(True)), ["question", "id"], "left")
    out = marked.groupBy("question").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_seen").isNull()).alias("fresh"))
    return out.withColumn("ratio", F.col("fresh") / F.col("total")).withColumn("exhausted", (F.col("fresh") == 0) | (F.col("ratio") < least))

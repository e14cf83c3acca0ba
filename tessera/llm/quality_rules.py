"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a cheap predicate over counted features. Its cost and its rejection rate are estimated on a
bounded sample, the rules are ordered by rejections per cost, and the verdict is one nested conditional in
that order, so that a row which an early rule rejects never reaches the later, dearer ones. The order
changes what is spent, never what is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, staged, table

#: White space between words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Rows, about, that the order of the rules is measured on, how often each rule is applied to them, and the least cost told apart.
SAMPLE_ROWS, REPEAT, LEAST_SECONDS = 500, 40, 0.001


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a row to drop. It may use the counted features and ``_text``."""

    name: str
    rejects: Callable[[], Column]


def _letters(pattern: str) -> Column:
    return F.length(F.regexp_replace("_text", pattern, ""))


#: Production rules. Each bound lies well outside what clean prose shows.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda: F.col("n_symbols") * 5 > F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("duplicate_lines", lambda: F.col("n_dup_lines") * 2 > F.size(F.split("_text", "\n"))),
    Rule("capitals", lambda: _letters(r"[^A-Z]+") * 2 > F.col("word_chars")),
    Rule("exclamations", lambda: _letters(r"[^!]+") * 2 > F.col("n_words")),
)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _text and the five counts; all work stays inside the row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    two = one.select("doc_id", "_text", words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    # A three-word window as one 64-bit hash beside its position; equal windows meet by sorting.
    grams = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
    )
    three = two.select("doc_id", "_text", "_words", "_lines", F.sort_array(grams).alias("_g"))
    again = F.filter("_g", lambda g, k: F.get("_g", k - 1)["h"].eqNullSafe(g["h"]) | F.get("_g", k + 1)["h"].eqNullSafe(g["h"]))
    four = three.select("doc_id", "_text", "_words", "_lines", F.sort_array(F.transform(again, lambda g: g["i"])).alias("_at"))
    # Each repeated window adds the words up to the next one, three at most.
    covered = F.aggregate(
        F.transform("_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1), i + 3) - i)), F.lit(0), lambda a, b: a + b
    )
    return four.select(
        "doc_id",
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def cascade(sample: DataFrame, rules: Sequence[Rule], repeat: int = REPEAT) -> list[Rule]:
    """``rules`` by rejections per second, as measured on ``sample`` (features of a bounded one; it fixes the order only).

    A rule's cost is the time that one task takes to apply it to the sample ``repeat`` times over, less that of
    counting the same rows without a rule, so that starting a job doesn't count.
    """
    names = ("_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    held = staged(sample.select(*names).coalesce(1))
    many = held.coalesce(1).withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

    def spent(found: Column) -> tuple[int, float]:
        best, seen = float("inf"), 0
        for _ in range(3):  # the first run also compiles
            begun = time.perf_counter()
            seen = many.agg(F.count_if(found)).first()[0]
            best = min(best, time.perf_counter() - begun)
        return seen, best

    rows, none = spent(F.length("_text") >= 0)
    timed = []
    for at, rule in enumerate(rules):
        seen, took = spent(rule.rejects())
        timed.append((-(seen / max(rows, 1)) / max(took - none, LEAST_SECONDS), at, rule))
    release(held)
    return [rule for *_, rule in sorted(timed, key=lambda t: t[:2])]


def judge(
    docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and the name of the rule that rejected the row.

    Some ``sample_rows`` rows, drawn at random from the whole table, order the rules. Null text has no words and fails the base
    rule; null, repeated and tied ids are rows like others; texts of any length are read whole; an empty table gives no rows;
    other columns are not read.
    """
    counted = features(docs, id_col, text_col)
    share = min(1.0, sample_rows / max(1, docs.count()))
    order = cascade(features(docs.select(id_col, text_col).sample(share, seed=7), id_col, text_col), rules)
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in order:
        verdict = verdict.when(rule.rejects(), F.lit(rule.name))
    return counted.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rejected_by").isNull().alias("kept"), "rejected_by",
    )


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule rejects a row first depends on the measured order, so only the verdict is returned."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rejected_by")


OP9_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM t
),
g AS (SELECT k, i, words[i:i + 2] AS gram FROM w, unnest(range(1, len(words) - 1)) u(i)),
hit AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n FROM hit, range(3) r(o) GROUP BY k),
f AS (
  SELECT doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (k)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 5 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR n_dup_lines * 2 > len(string_split(text, chr(10)))
    OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > word_chars
    OR 2 * length(regexp_replace(text, '[^!]+', '', 'g')) > n_words) AS kept
FROM b
"""

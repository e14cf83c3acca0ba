"""Column expressions over text: tokens, identifiers, terms, token counts, cuts. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a question's topic, and spellings of one topic.
TOPIC_STOP_WORDS = (
    "a an and application code does do for from how in into is load loading of on or the this to values what with "
    "work works working happen happens happening explain explains understand describe describes show shows"
).split()
TOPIC_ALIASES = {
    "configuration": "config", "configure": "config", "configured": "config", "configuring": "config",
    "environment": "env", "variable": "env", "variables": "env",
}
#: Phrases that name no symbol.
PHRASE_STOP_WORDS = (
    "how does do did is are was were a an the to into of for in on with every major component components explain "
    "describe what which why when"
).split()

#: Endings that a stem loses, the first that fits; what is put before a question that is embedded.
SUFFIXES = ("ing", "ed", "es", "s")
INSTRUCTION = "Represent this sentence for searching relevant passages: "
#: Words of a question that name no symbol, for the rewriter and for the agent's phrases.
IGNORED_WORDS = "what where when why how is are does do the a an of to in for about explain describe tell show find".split()
AGENT_STOP_WORDS = "a an and are does do for from how in into is of on or the to what where which with why".split()


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and underscore, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def dotted_identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"), F.lit(0))


def without_words(words: Column, stop: list[str]) -> Column:
    held = F.array(*[F.lit(w) for w in stop])
    return F.filter(words, lambda w: ~F.array_contains(held, F.lower(w)))


def sole_symbol(question: Column) -> Column:
    """The one identifier of a question that isn't an ignored word; null where there are none or several."""
    left = without_words(identifiers(question), IGNORED_WORDS)
    return F.when(F.size(left) == 1, F.get(left, F.lit(0)))


def agent_phrases(query: Column) -> Column:
    """The identifiers, dotted ones whole, of a retrieval query that aren't stop-words."""
    return without_words(dotted_identifiers(query), AGENT_STOP_WORDS)


def stem(word: Column) -> Column:
    """Drops one of ing, ed, es, s where more than two letters stay."""
    cut = word
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        cut = F.when(word.endswith(suffix) & (F.length(word) - n > 2), F.substring(word, F.lit(1), F.length(word) - n)).otherwise(cut)
    return cut


def topic_terms(text: Column) -> Column:
    """Distinct lower-case identifiers that name a topic, aliases replaced, sorted."""
    stop = F.array(*[F.lit(w) for w in TOPIC_STOP_WORDS])
    alias = F.create_map(*[F.lit(x) for kv in TOPIC_ALIASES.items() for x in kv])
    words = F.filter(identifiers(F.lower(text)), lambda w: ~F.array_contains(stop, w))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.coalesce(alias[w], w))))


def haystack_terms(text: Column) -> Column:
    """Identifiers and their underscore parts, stemmed, distinct, sorted."""
    words = identifiers(F.lower(text))
    parts = F.flatten(F.transform(words, lambda w: F.filter(F.split(w, "_"), lambda p: p != "")))
    return F.array_sort(F.array_distinct(F.transform(F.concat(words, parts), stem)))


def entity_terms(text: Column) -> Column:
    """Stemmed parts of words that look like code: with an underscore or dot, mixed case, or capitals, of three letters or more."""
    code = F.filter(
        dotted_identifiers(text),
        lambda w: (F.length(w) >= 3) & (w.contains("_") | w.contains(".") | w.rlike("[a-z][A-Z]|[A-Z]{2}[a-z]") | ((w == F.upper(w)) & w.rlike("[A-Z]"))),
    )
    parts = F.flatten(F.transform(code, lambda w: F.regexp_extract_all(w, F.lit("[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: stem(F.lower(p)))))


def overlap(query: Column, held: Column) -> Column:
    """Share of the query's terms that ``held`` has; 0 for a query without terms."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, held)) / F.size(query))


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def bare_name(symbol: Column) -> Column:
    return F.element_at(F.split(symbol, r"\."), -1)


def owner(symbol: Column) -> Column:
    """What stands before a symbol's last dot; null for a bare name."""
    return F.when(symbol.contains("."), F.regexp_extract(symbol, r"^(.*)\.[^.]*$", 1))


def same_symbol(symbol: Column, name: Column) -> Column:
    """Equal as written, or in their last parts."""
    return (symbol == name) | (bare_name(symbol) == name) | (bare_name(symbol) == bare_name(name))


def token_count(text: Column) -> Column:
    """An estimate of four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def cut_to_tokens(text: Column, n: Column | int) -> Column:
    return F.substring(text, F.lit(1), (F.lit(n) if isinstance(n, int) else n) * 4)


def without_blank_lines(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\n[ \t]*\n+", "\n"))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_production(path: Column, anchored: bool = True) -> Column:
    """Not under a tests or examples folder. Unanchored, such a folder at the root doesn't count."""
    whole = F.concat(F.lit("/"), forward_slashes(path)) if anchored else forward_slashes(path)
    return ~(whole.contains("/tests/") | whole.contains("/examples/"))


def json_object(text: Column) -> Column:
    """The JSON object in a model's noisy answer: what a code fence holds, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braced != "", braced)


def repaired_json(text: Column) -> Column:
    """A truncated JSON object with its open string, arrays and objects closed, in the order they were opened.

    A comma or colon that nothing follows goes with the key before it. The brackets outside strings are folded into a stack.
    """
    plain = F.regexp_replace(text, r'\\\\.', '')
    quotes = F.regexp_count(plain, F.lit('"'))
    closed = F.when(quotes % 2 == 1, F.concat(text, F.lit('"'))).otherwise(text)
    closed = F.regexp_replace(closed, r'(?:,\s*|,?\s*"[^"]*"\s*:\s*)$', "")
    outside = F.regexp_replace(F.regexp_replace(closed, r'\\\\.', ''), r'"[^"]*"', "")
    brackets = F.regexp_extract_all(outside, F.lit(r"[\[\]{}]"), F.lit(0))
    stack = F.aggregate(
        brackets, F.lit(""), lambda held, c: F.when(c == "{", F.concat(F.lit("}"), held)).when(c == "[", F.concat(F.lit("]"), held)).otherwise(F.substring(held, F.lit(2), F.length(held)))
    )
    return F.concat(closed, stack)


def query_prefix(text: Column, instruction: str = INSTRUCTION) -> Column:
    return F.concat(F.lit(instruction), text)

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import pytest

from tessera.llm import decontamination, html_text, language_model, near_dedup, paragraph_dedup, quality_rules, sharding, substring_tree, toxicity

# Extra columns bear the names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, _row string, key string, id long, band int"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion of moss and thunder near the old mill. "


def rows():
    made = [
        (1, PROSE * 3, "en"), (1, PROSE * 3, "en"), (2, PROSE * 3, "en"), (3, None, "en"), (4, "", None), (5, "   \n ", "en"), (None, "no id here", "en"),
        (6, "word " * 20_000, "fr"), (7, "é" * 3000, "fr"), (8, "short", "de"), (9, "zero\x00byte � 你好", "de"), (None, None, None),
    ]
    return [(*r, "clash", "clash", 9, 7) for r in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "seven wizards brew a potion of moss and thunder near the old mill"), (2, None), (None, "short"), (3, "")], "item_id long, text string")


def test_sharding(docs, none):
    out = sharding.shard(docs, [1.0, 2.0, 1.0], rows_per_range=2).collect()
    assert len(out) == len(rows())
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 3) for r in out)
    assert {(r.doc_id, r.size) for r in out if r.doc_id in (3, 4)} == {(3, 8), (4, 8)}
    assert sharding.shard(none, [1.0]).collect() == []


def test_quality_rules(docs, none):
    out = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert out[3].n_words == 0 and out[3].base_failed and not out[3].kept
    assert out[6].n_words == 20_000 and out[6].n_repeat_words == 20_000 and out[6].base_failed
    assert quality_rules.judge(none).collect() == []


def test_decontamination(docs, none, items):
    out = decontamination.scan(docs, items, automaton_bytes=16).collect()
    assert len(out) == len(rows())
    one = next(r for r in out if r["_row"]["doc_id"] == 1)
    assert one.items == ["1"] and one.n_hit == 39
    assert [r.n_hit for r in out if r["_row"]["doc_id"] == 8] == [1]
    again = decontamination.scan(docs, items).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    cut = {r.doc_id: r for r in decontamination.cut(docs, items).collect()}
    assert "wizards" not in cut[1].text and cut[1].key == "clash" and 8 not in cut and cut[6].text == "word " * 20_000
    assert decontamination.scan(none, items).collect() == [] == decontamination.cut(none, items).collect()
    assert {r.n_hit for r in decontamination.scan(docs, items.limit(0)).collect()} == {0}


def test_toxicity(docs, none, labels):
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(none, model).collect() == []
    assert toxicity.train([]).score(__import__("numpy").zeros((1, toxicity.N_FIGURES)))[0] < 0.5


def test_language_model(docs, none, labels):
    out = language_model.judge(docs, labels).collect()
    assert len(out) == len(rows()) and all(r.perplexity > 0 for r in out)
    assert all(r.kept for r in language_model.judge(docs, labels.limit(0)).collect())
    assert language_model.judge(none, labels).collect() == []


def test_near_dedup(docs, none):
    out = near_dedup.classes(docs).collect()
    assert len(out) == len(rows())
    by = {r.id: r.class_id for r in out if r.id is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3 and by[5] == 5
    one = near_dedup.one_of_each(docs).collect()
    assert len(one) == len({r.class_key for r in out}) and one[0]._row == "clash"
    assert near_dedup.classes(none).collect() == []


def test_substring_tree(docs, none):
    out = substring_tree.digest(docs).collect()
    assert len(out) == len(rows())
    by = {r.id: r for r in out if r.id is not None}
    assert by[1].n_removed == by[1].n_bytes and by[6].n_removed == 100_000 and by[3].n_bytes == 0 and by[8].n_removed == 0
    left = {r.doc_id: r for r in substring_tree.stripped(docs).collect()}
    assert 1 not in left and left[8].text == "short" and left[8].key == "clash"
    assert substring_tree.digest(none).collect() == []


def test_paragraphs(docs, none):
    out = paragraph_dedup.repeats(docs).collect()
    assert {r.id for r in out} <= {1, 2, 6} and {1, 2} <= {r.id for r in out}
    assert paragraph_dedup.repeats(none).collect() == []


def test_pages(spark):
    pages = [(1, "http://a.b/1", "<p>x"), (1, "http://a.b/1", "<p>x"), (2, None, None), (3, "odd", ""), (4, "http://a.b/2", "<div>" * 3000 + "deep" + "<script>var a = '<p>no</p>'")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, _html string")
    out = html_text.extract(frame).collect()
    assert sorted(r.text for r in out) == ["", "", "deep", "x", "x"] and out[0]["_row"]["_html"] == "clash"
    assert html_text.extract(frame.limit(0)).collect() == []

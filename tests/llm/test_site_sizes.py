"""Template is judged by its importance on hosts of few pages and in rare branches of large ones."""

from tessera.llm import html_text


def texts(spark, rows):
    return {r["_row"]["page_id"]: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_of_a_small_site_is_cut(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(k, f"http://small.y/{k}", f"<body><div class=top>Same line everywhere</div><div class=own>{words[k]} own text</div></body>") for k in range(4)]
    # Two pages of a host are too few to tell template from a copied text, unless other hosts know the branch.
    rows += [(k, f"http://two.y/{k}", f"<body><div class=aside>Said twice</div><div class=own>{words[k - 10]} here</div></body>") for k in (10, 11)]
    rows += [(k, f"http://three.y/{k}", f"<body><div class=top>Said twice</div><div class=own>{words[k - 20]} there</div></body>") for k in (20, 21)]
    rows += [(30, "http://one.y/", "<body><div class=top>Said once</div><div class=own>single page</div></body>")]
    got = texts(spark, rows)
    assert got[20] == "alpha there" and got[21] == "beta there" and got[30] == "single page"
    assert {k: got[k] for k in range(4)} == {k: f"{words[k]} own text" for k in range(4)}
    assert got[10] == "Said twice\n\nalpha here" and got[11] == "Said twice\n\nbeta here"


def test_rare_template_of_a_large_site_is_cut(spark):
    head = lambda k: "<div class=strip>Rare line of one section</div>" if k < 12 else ""
    rows = [(k, f"http://large.y/{k}", f"<body>{head(k)}<div class=own>text number {k} of the host</div></body>") for k in range(1300)]
    assert texts(spark, rows) == {k: f"text number {k} of the host" for k in range(1300)}

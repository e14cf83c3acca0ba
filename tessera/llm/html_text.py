"""Main text of web pages by a site style tree.

The pages of one host are merged into a tree of element paths. A path whose presentation and content hardly
vary over the host's pages (entropy near its maximum: the same everywhere) is template, and its branch is cut
from every page. Where a host has few pages, what all hosts together tell of a path counts too. Parts that differ from page
to page and still aren't the article (adverts, reader comments, forms) show in no entropy; those go by their element or
name, and a page that marks its article keeps to it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, passed, release, staged, table
from .near_dedup import text_key

#: Element names by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object video audio canvas noframes xmp".split())
TEMPLATE = frozenset("head nav footer aside form button select menu dialog search label fieldset".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
LISTS = frozenset("ul ol dl table select menu".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that name parts around an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies discussion disqus feedback footer form gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: A path is template below this importance, once blended with PRIOR pages of the path's importance on other hosts, which is
#: itself blended with PRIOR pages of importance 1: few pages say little.
IMPORTANCE, PRIOR, DECAY = 0.3, 1, 0.9

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_STOP = re.compile(r"""["'<>]""")
#: Characters in which a tag is looked for by one pattern; longer ones are read stop by stop.
_NEAR = 2000
_NAMED = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)


@dataclass(slots=True)
class Node:
    """An element that tells blocks apart. ``path`` stands for the labels from the root; the flags: template by element, by name,
    inside an article, and whether a label inside the article names a class or id."""

    parent: int
    path: int
    by_element: bool
    by_name: bool
    article: bool
    named: bool


@dataclass(slots=True)
class Block:
    node: int
    text: str


@dataclass(slots=True)
class Page:
    """The nodes of a page, parents first, its blocks in order, and a digest of the child sequence of each inner path."""

    nodes: list[Node]
    blocks: list[Block]
    styles: dict[int, int]


_MASK = (1 << 64) - 1


def _step(h: int, label: str) -> int:
    """The path below ``h``, as a signed 64-bit number."""
    return (xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), h & _MASK) ^ (1 << 63)) - (1 << 63)


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of tags, comments and declarations (name empty), in time linear in the page.

    A < from which no tag can be closed is text; so are all < outside quotes that such an attempt has passed.
    """
    at, dead, gone = 0, set(), {}
    while (lt := page.find("<", at)) >= 0:
        at = lt + 1
        if page.startswith(("<!", "<?"), lt):
            to = page.find("-->" if page.startswith("<!--", lt) else ">", lt + 2)
            at = len(page) if to < 0 else to + (3 if page.startswith("<!--", lt) else 1)
            yield lt, at, "", "", ""
            continue
        if lt in dead or not (page[lt + 1 : lt + 2].isalpha() or page.startswith("</", lt)):
            continue
        m = _TAG.match(page, lt, lt + _NEAR)
        if m is not None:
            at = m.end()
            yield lt, at, m[1], m[2].lower(), m[3]
            continue
        passed, i = [], lt + 1
        while (stop := _STOP.search(page, i)) is not None and stop[0] != ">":
            c, i = stop[0], stop.end()
            if c == "<":
                passed.append(stop.start())
                continue
            if gone.get(c, len(page)) <= i or (to := page.find(c, i)) < 0:
                gone[c] = min(i, gone.get(c, i))
                stop = None
                break
            i = to + 1
        m = _HEAD.match(page, lt)
        if stop is None or m is None:
            dead.update(passed)
            continue
        at = stop.end()
        yield lt, at, m[1], m[2].lower(), page[m.end() : at - 1]


_HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")


def parse(page: str | None) -> Page:
    """The page's blocks in order: text with references decoded and white space made one space.

    Work and memory are linear in the page, however deep its elements are nested and whatever stays unclosed.
    """
    page = page or ""
    out = Page([Node(-1, 0, False, False, False, False)], [], {})
    nodes = out.nodes
    stack: list[tuple[str, int]] = [("", 0)]
    open_: Counter[str] = Counter()
    held: list[str] = []
    told = [False]
    last: dict[int, int] = {}

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if not text:
            return
        node = stack[-1][1]
        out.blocks.append(Block(node, text))
        while node and not told[node]:  # each node is told to its parent once, when it has its first text
            told[node] = True
            above, path = nodes[nodes[node].parent].path, nodes[node].path
            if last.get(above) != path:
                last[above] = path
                out.styles[above] = _step(out.styles.get(above, 0), str(path))
            node = nodes[node].parent

    def close(k: int) -> None:
        if any(tag in BLOCKS for tag, _ in stack[k:]):
            flush()
        open_.subtract(tag for tag, _ in stack[k:])
        del stack[k:]

    def close_last(tags, until) -> None:
        if any(open_[t] > 0 for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    close(k)
                    break
                if stack[k][0] in until:
                    break

    at, raw = 0, -1
    for start, end, slash, tag, attributes in _tags(page):
        if start < raw:
            continue
        if start > at:
            held.append(html.unescape(page[at:start]))
        at = end
        if not tag:
            continue
        if slash:
            if open_[tag] > 0:
                close_last((tag,), ())
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = raw = found.end() if found else len(page)
            if tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                close_last(("p",), BLOCKS)
            if tag in CLOSES:
                close_last(CLOSES[tag], LISTS)
            if tag == "body":
                close_last(("head",), ())
        if tag in VOID:
            continue
        above = stack[-1][1]
        top = nodes[above]
        label, named, hinted = tag, False, False
        if attributes and "=" in attributes or "hidden" in attributes:
            for kind, a, b, c in _NAMED.findall(attributes):
                value = a or b or c
                hinted |= bool({p.lower() for p in _PART.findall(value)} & NAMES)
                if kind.lower() != "role":
                    label += "." + re.sub(r"\d+", "#", value.strip())
                    named = True
            hinted |= bool(_HIDDEN.search(attributes))
        marks = tag in ("article", "main")
        by_element = top.by_element or tag in TEMPLATE or (tag == "header" and not top.article)
        by_name = top.by_name or (hinted and (tag not in ("html", "body", "article", "main") or (tag == "article" and top.article)))
        open_[tag] += 1
        if tag in BLOCKS or (by_element, by_name) != (top.by_element, top.by_name):
            nodes.append(Node(above, _step(top.path, label), by_element, by_name, top.article or marks, top.named or (named and top.article)))
            told.append(False)
            stack.append((tag, len(nodes) - 1))
        else:
            stack.append((tag, above))
    if at < len(page):
        held.append(html.unescape(page[at:]))
    flush()
    return out


def _digest(*values: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(values).encode("utf-8", "surrogatepass")) - (1 << 63)


def _features(page: str | None) -> tuple[int, list[dict]]:
    parsed = parse(page)
    texts = [(parsed.nodes[b.node].path, b.text) for b in parsed.blocks]
    rows = {(path, TEXT, _digest(text)) for path, text in texts} | {(path, PRESENT, 0) for path, _ in texts}
    rows |= {(path, STYLE, chain) for path, chain in parsed.styles.items()}
    return _digest(*(f"{path}\0{text}" for path, text in texts)), [{"path": p, "kind": k, "feature": f} for p, k, f in sorted(rows)]


#: What a page tells of a path: a text it has there, that it has any, and how its children follow each other.
TEXT, PRESENT, STYLE = 0, 1, 2
_ROW = pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64())])


def features(pages: DataFrame, *, host: str = "_host", html_col: str = "_html") -> DataFrame:
    """(host, key, page, rows) of every page: the key of its source, the digest of its blocks, what it tells of its paths."""

    def found(batch: pa.RecordBatch) -> list[pa.Array]:
        both = [_features(x) for x in batch.column(0).to_pylist()]
        return [pa.array([p for p, _ in both], pa.int64()), pa.array([r for _, r in both], pa.list_(_ROW))]

    keyed = pages.select(F.col(host).alias("host"), text_key(F.col(html_col)).alias("key"), F.col(html_col).alias("_text"))
    seen = passed(keyed, {"_text": F.col("_text")}, found, "page long, rows array<struct<path:long,kind:int,feature:long>>", ["host", "key"])
    return seen.select("_row.host", "_row.key", "page", "rows")


def style_tree(seen: DataFrame) -> DataFrame:
    """(host, path, pages, importance) over the distinct pages of every host, of rows of features().

    Content: 1 minus the mean, over the different texts of a path, of the entropy of a text's spread over the
    pages that have the path, to the base of their number. Presentation: the entropy of the child sequences.
    A path with both weighs the presentation by 1 - 0.9**n of its n child sequences, as in the composite
    importance of a style tree. All is counted by aggregation with partial sums, so a large host is no large task.
    """
    one = seen.select("host", "page", "rows").dropDuplicates(["host", "page"])
    counted = one.select("host", F.inline("rows")).groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    tree = counted.groupBy("host", "path").agg(
        F.count_if(F.col("kind") == TEXT).alias("texts"), F.sum(of(TEXT, F.log("n"))).alias("log_n"), F.max(of(PRESENT, F.col("n"))).alias("with_text"),
        F.count_if(F.col("kind") == STYLE).alias("styles"), F.sum(of(STYLE, F.col("n"))).alias("with_style"), F.sum(of(STYLE, F.col("n") * F.log("n"))).alias("n_log_n"),
    )
    base = lambda m: F.log(F.col(m).cast("double"))
    content = F.when(F.col("with_text") > 1, 1 - F.col("log_n") / F.col("texts") / base("with_text")).when(F.col("with_text") == 1, 1.0)
    shown = F.when(F.col("with_style") > 1, 1 - F.col("n_log_n") / F.col("with_style") / base("with_style")).when(F.col("with_style") == 1, 1.0)
    weight = 1 - F.pow(F.lit(DECAY), F.col("styles"))
    # A path without text of its own isn't judged: its leaves are.
    importance = F.when(F.col("with_style").isNull() | content.isNull(), content).otherwise(weight * shown + (1 - weight) * content)
    return tree.select("host", "path", F.greatest("with_text", "with_style").alias("pages"), importance.alias("importance"))


def templates(tree: DataFrame, least: float = IMPORTANCE) -> DataFrame:
    """(host, path) of the template branches of rows of style_tree().

    A path's importance on its host is blended with what the other hosts tell of it; a host of one page says nothing itself.
    """
    seen = tree.where("importance is not null")
    told = F.when(F.col("pages") > 1, F.col("pages")).otherwise(0)
    seen = seen.withColumn("told", told).withColumn("weight", told * F.col("importance"))
    everywhere = seen.groupBy("path").agg(F.sum("told").alias("all_told"), F.sum("weight").alias("all_weight"))
    others = (F.col("all_weight") - F.col("weight") + PRIOR) / (F.col("all_told") - F.col("told") + PRIOR)
    met = hot_join(seen, everywhere, "path").withColumn("others", others)
    blended = (F.col("weight") + PRIOR * F.col("others")) / (F.col("told") + PRIOR)
    return met.where(blended < least).select("host", "path")


def main_text(page: Page, cut: set[int]) -> str:
    """The blocks that stay once the branches in ``cut`` and other template are gone, joined by an empty line.

    Unnamed elements of an article are never cut: on a host of few templates plain paragraphs share one path. An article of
    which nothing but the name of a wrapper speaks for template stays if there is no other.
    """
    gone = [False]
    for n in page.nodes[1:]:
        gone.append(gone[n.parent] or n.path in cut)
    own = [(page.nodes[b.node], b.text, gone[b.node]) for b in page.blocks]
    left = [(n, t) for n, t, out in own if not n.by_element and (not out or (n.article and not n.named))]
    stay = [(n, t) for n, t in left if not n.by_name]
    if any(n.article for n, _ in stay):
        stay = [(n, t) for n, t in stay if n.article]
    elif any(n.article for n, _ in left):
        stay = [(n, t) for n, t in left if n.article]
    return "\n\n".join(t for _, t in stay)


def extract(pages: DataFrame, *, html_col: str = "html", url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Each row as struct ``_row`` with its main text.

    Pages without a host (null or odd urls) form one site of their own. Null and empty pages give an empty text;
    repeated pages count once in the tree and are all returned; very long pages are read whole; an empty table
    gives no rows. Every path of every host is judged, on however few of its pages it is. Template paths meet the
    branches of each page, so a page gets those of its own branches only and no list grows with its host.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    kept = pages.columns if keep is None else keep
    sites = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_page"), host.alias("_host"), F.col(html_col).cast("string").alias("_html"))
    seen = staged(features(sites.select("_host", "_html")))
    template = staged(templates(style_tree(seen)))
    branches = seen.select("host", "key", F.explode(F.expr("array_distinct(rows.path)")).alias("path"))
    # Neither side is ever broadcast: both grow with the pages.
    cut = staged(branches.join(template.hint("merge"), ["host", "path"]).groupBy("host", "key").agg(F.collect_set("path").alias("_cut")))
    joined = sites.join(cut.hint("merge"), (F.col("_host") == F.col("host")) & (text_key(F.col("_html")) == F.col("key")), "left").select("_page", "_html", "_cut")
    release(seen, template)

    def text(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(parse(h), set(c or ())) for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())]

    done = passed(joined, {"_html": "_html", "_cut": F.col("_cut")}, text, "text string", ["_page"])
    return done.select(F.col("_row._page").alias("_row"), "text")


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"]).select(
        F.col("_row.page_id").alias("page_id"), F.col("_row.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars")
    )

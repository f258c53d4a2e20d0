"""Operator 2, HTML extraction: equivalence-class template deduction.

Tokens of a page are its structural elements, named by the path of tags and classes that leads to
them, and its runs of text of any length, named by path and wording. A token's occurrence vector is
how often it occurs on each page of a host; pages that are equal byte for byte count once. Spark adds
up a fingerprint of the vector for each (host, token), whatever the number of pages; tokens of most
pages with equal vectors form an equivalence class. A class is valid if it has two or more members
that stand in one order on all its pages. Valid classes nest by the paths of their elements, which
gives the host's template; what lies between its tokens are slots. The main slot is the template's
article or main element, else its deepest element that holds most of the text outside of menus,
forms and the like. Extraction reads the blocks of that slot, inside articles too without the runs
of text that belong to the template. Names (tags, roles, classes) tell what a slot that varies from
page to page is for, as an advert or readers' comments look like text otherwise; such slots are left
out. Pages without a usable template (too few pages on the host, or without its main slot) fall back
on their own article or main element, or all their text.

The page parser is a small per-page helper, linear in the page; counting, classes, order, templates
and the choice of slots are Spark aggregations, and a template (one row a host, bounded by what most
of its pages share) is joined back to the pages.

Edge cases: null or empty html gives an empty text; a null or unusual url belongs to the host "";
broken markup (open tags, stray ends, unclosed comments, any depth) never fails; repeated page ids
give a row each; extra columns pass through, but ``text`` is replaced.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_array, materialize, release, ship

#: A class is part of the template if it is on this share of a host's pages, and on this many.
SHARE = 0.6
LEAST_PAGES = 4
#: A run of text inside an article has to be on this share: headings that many articles have in common stay.
ARTICLE_SHARE = 0.9
#: An element is the main slot if it holds this share of the text that is not set aside.
MAIN_SHARE = 0.6

DROPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea input iframe svg canvas object dialog menu".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
ENDS_P = BLOCKS - {"br", "html", "body"}
#: Whole names of classes and ids; a name that only holds one of these says nothing.
SET_ASIDE = frozenset("""ad ads advert advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead header footer
 cookie cookies consent notice notices popup modal newsletter subscribe signup login share sharing social related recommended comment comments reply replies disqus widget pagination pager toolbar
 ad-banner ad-slot ad-container cookie-notice cookie-banner cookie-consent site-header site-footer site-nav site-menu main-nav main-menu share-buttons social-share related-posts related-articles
 newsletter-signup user-comments reader-comments post-comments comment-list comment-section comments-area""".split())
READERS = frozenset("comment comments reply replies disqus user-comments reader-comments post-comments comment-list comment-section comments-area".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


class _Element:
    """An open element: its tag, the name of its path (a hash, so that depth costs nothing), and what it inherits."""

    __slots__ = ("tag", "path", "up", "aside", "readers", "article", "inside", "link", "depth")

    def __init__(self, tag: str, path: int, up: int, aside: bool, readers: bool, article: bool, inside: bool, link: bool, depth: int):
        self.tag, self.path, self.up, self.aside, self.readers, self.article, self.inside, self.link, self.depth = tag, path, up, aside, readers, article, inside, link, depth


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def _open(parent: _Element, tag: str, attributes: str, roots: set[int]) -> _Element:
    names, main = "", tag in ("article", "main")
    # The header of an article holds its headline; a page's header stands outside of articles.
    aside = tag in DROPPED and not (tag == "header" and parent.article)
    readers = False
    if attributes and tag not in ("html", "body"):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "style" and _NO_DISPLAY.search(value)):
                aside = True
            elif key == "role":
                main = main or value in ("main", "article")
                aside = aside or value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
            elif key in ("class", "id"):
                names += "." + value
                for name in value.replace("_", "-").split():
                    aside = aside or name in SET_ASIDE
                    readers = readers or name in READERS
    aside = aside or (parent.aside if not main else parent.readers or parent.tag in DROPPED)
    structural = tag in BLOCKS and tag != "br"
    path = _hash(f"{parent.path}/{tag}{names}") if structural else parent.path
    inside = parent.inside or (structural and path in roots)
    article = parent.article or (main and not aside)
    return _Element(tag, path, parent.path if structural else parent.up, aside, readers or parent.readers, article, inside, parent.link or tag == "a", parent.depth + structural)


def parse(page: str, roots: set[int] = frozenset()):
    """Yields ("open", element, starts an article, block) for structural elements and ("text", element, text, block) for runs of text.

    ``block`` counts up at every boundary between blocks. Time and memory are linear in the page, however deep it nests.
    """
    stack = [_Element("", 0, 0, False, False, False, False, False, 0)]
    opened: dict[str, int] = {}
    block, at, size = 0, 0, len(page)

    def close(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    while at < size:
        m = _TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at:
            yield "text", stack[-1], page[at:start], block
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            if tag in BLOCKS:
                block += 1
            continue
        if tag in BLOCKS:
            block += 1
            if tag in ENDS_P and opened.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in BLOCKS:
                        break
            if tag in ("li", "tr", "td", "th", "dt", "dd") and stack[-1].tag == tag:
                close(len(stack) - 1)
        element = _open(stack[-1], tag, attributes, roots)
        if tag in BLOCKS and tag not in VOID:
            yield "open", element, element.article and not stack[-1].article, block
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            # What is inside is not markup, and never text of the page.
            ending = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = ending.end() if ending else size
            continue
        stack.append(element)
        opened[tag] = opened.get(tag, 0) + 1


def text_token(path: int, text: str) -> int:
    return _hash(f"{path}\n{text}")


TOKENS = "array<struct<token: bigint, up: bigint, is_text: boolean, article: boolean, place: int, depth: int, n: int, chars: bigint, links: bigint>>"


def page_tokens(page: str) -> list[tuple]:
    """Each token of a page: the element around it, its first place and how often it occurs; for elements the text they hold that is not set aside."""
    elements: dict[int, list] = {}
    texts: dict[int, list] = {}
    place = 0
    for kind, e, what, _ in parse(page):
        if kind == "open":
            place += 1
            if e.path in elements:
                elements[e.path][4] += 1
            else:
                elements[e.path] = [e.up, what, place, e.depth, 1, 0, 0, e.aside]
            continue
        text = " ".join(what.split())
        if not text:
            continue
        place += 1
        token = text_token(e.path, text)
        if token in texts:
            texts[token][4] += 1
        else:
            texts[token] = [e.path, e.article, place, e.depth, 1]
        if not e.aside and e.path in elements:
            elements[e.path][5] += len(text)
            elements[e.path][6] += len(text) if e.link else 0
    # An element stands behind the one around it, so one pass from the end sums up all text inside.
    for path in reversed(elements):
        up = elements.get(elements[path][0])
        if up is not None:
            up[5] += elements[path][5]
            up[6] += elements[path][6]
    out = [(t, up, False, a, at, d, n, 0 if aside else c, k) for t, (up, a, at, d, n, c, k, aside) in elements.items()]
    return out + [(t, up, True, a, at, d, n, 0, 0) for t, (up, a, at, d, n) in texts.items()]


def extract(page: str, roots: set[int], boilerplate: set[int]) -> str:
    """Blocks of the main slot, without the runs of text of the template, joined by line ends."""
    blocks: dict[str, list[list[str]]] = {}
    last: dict[str, int] = {}

    def add(where: str, block: int, text: str) -> None:
        parts = blocks.setdefault(where, [])
        if last.get(where) != block:
            parts.append([])
            last[where] = block
        parts[-1].append(text)

    for kind, e, what, block in parse(page, roots):
        if kind != "text" or e.aside:
            continue
        if boilerplate and text_token(e.path, " ".join(what.split())) in boilerplate:
            what = " "
        if e.inside:
            add("slot", block, what)
        if e.article:
            add("article", block, what)
        if not roots or not (e.inside or e.article):
            add("rest", block, what)
    chosen = blocks.get("slot") or blocks.get("article") or blocks.get("rest") or []
    texts = (" ".join(entities.unescape("".join(parts)).split()) for parts in chosen)
    return "\n".join([t for t in texts if t])


def _tokens(pages: pa.Array) -> pa.Array:
    types = {"token": pa.int64(), "up": pa.int64(), "is_text": pa.bool_(), "article": pa.bool_(), "place": pa.int32(), "depth": pa.int32(), "n": pa.int32(), "chars": pa.int64(), "links": pa.int64()}
    rows = [page_tokens(p.as_py() or "") for p in as_array(pages)]
    flat = list(zip(*[t for r in rows for t in r], strict=True)) or [[] for _ in types]
    fields = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, types.values(), strict=True)], list(types))
    sizes = np.cumsum([0] + [len(r) for r in rows])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), fields)


def _extract(pages: pa.Array, roots: pa.Array, boilerplate: pa.Array) -> pa.Array:
    seen: dict[tuple, tuple] = {}
    out = []
    for p, r, b in zip(as_array(pages), as_array(roots).to_pylist(), as_array(boilerplate).to_pylist(), strict=True):
        key = (tuple(r or ()), tuple(b or ()))
        if key not in seen:
            seen[key] = set(key[0]), set(key[1])
        out.append(extract(p.as_py() or "", *seen[key]))
    return pa.array(out, pa.string())


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def template_tokens(df: DataFrame, url: str = "url", html: str = "html", share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The template of each host: a row for each token (host, token, up, is_text, article, depth, chars, links, support, pages) with its ``class`` and its ``rank`` in that class's order."""
    ship(df.sparkSession)
    # Copies of a page say nothing of its template: each different page of a host counts once.
    page = F.xxhash64(F.col(html)).alias("page")
    pages = df.select(host_of(url).alias("host"), page, F.arrow_udf(_tokens, TOKENS)(F.col(html)).alias("tokens")).dropDuplicates(["host", "page"])
    rows = materialize(pages.select("host", "page", F.inline("tokens")), "html-tokens")
    sizes = rows.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector")
    same = [F.first(c).alias(c) for c in ("up", "is_text")]
    tokens = rows.groupBy("host", "token").agg(
        vector, F.count(F.lit(1)).alias("support"), *same, F.max("article").alias("article"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    most = F.when(F.col("is_text") & F.col("article"), F.lit(max(share, ARTICLE_SHARE))).otherwise(F.lit(share))
    frequent = tokens.join(sizes, "host").filter((F.col("support") >= least_pages) & (F.col("support") >= most * F.col("pages")))
    # Equal occurrence vectors make a class.
    frequent = materialize(frequent.withColumn("class", F.xxhash64("vector", "support")).drop("vector"), "html-frequent")
    # Order: a member that stands at different places among its class's members is no part of it.
    here = Window.partitionBy("host", "page", "class").orderBy("place", "token")
    placed = rows.select("host", "page", "token", "place").join(frequent.select("host", "token", "class"), ["host", "token"]).withColumn("rank", F.row_number().over(here))
    ranks = placed.groupBy("host", "token").agg(F.min("rank").alias("rank"), F.max("rank").alias("highest")).filter(F.col("rank") == F.col("highest")).drop("highest")
    members = Window.partitionBy("host", "class")
    valid = frequent.join(ranks, ["host", "token"]).withColumn("members", F.count(F.lit(1)).over(members)).filter("members >= 2").drop("members")
    valid = materialize(valid, "html-templates")
    release(rows, frequent)
    return valid


def deduce_templates(df: DataFrame, url: str = "url", html: str = "html", share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row a host: host, roots array<long> (elements that are the main slot), boilerplate array<long> (runs of text of the template)."""
    valid = template_tokens(df, url, html, share, least_pages)
    text = F.when(~F.col("is_text"), F.col("chars")).otherwise(F.lit(0))
    whole = Window.partitionBy("host")
    element = ~F.col("is_text") & (F.col("chars") > 0)
    marked = valid.withColumn("most", F.max(text).over(whole)).withColumn("articles", F.max(element & F.col("article")).over(whole))
    holds = element & (F.col("chars") >= MAIN_SHARE * F.col("most")) & (2 * F.col("links") <= F.col("chars"))
    marked = marked.withColumn("deepest", F.max(F.when(holds, F.struct("depth", "chars", "token"))).over(whole)["token"])
    root = F.when(F.col("articles"), F.col("article")).otherwise(F.col("token") == F.col("deepest"))
    return marked.groupBy("host").agg(
        F.sort_array(F.collect_set(F.when(element & root, F.col("token")))).alias("roots"),
        F.sort_array(F.collect_set(F.when(F.col("is_text"), F.col("token")))).alias("boilerplate"),
    )


def extract_text(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``df`` with ``text``: the main text of each page."""
    ship(df.sparkSession)
    templates = materialize(deduce_templates(df, url, html), "html-slots")
    cols = [F.col(c) for c in df.columns if c != "text"]
    joined = df.withColumn("__host", host_of(url)).join(templates.withColumnRenamed("host", "__host"), "__host", "left")
    return joined.select(*cols, F.arrow_udf(_extract, "string")(F.col(html), F.col("roots"), F.col("boilerplate")).alias("text"))

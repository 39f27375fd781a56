"""Operator 2: main text of web pages by equivalence-class template deduction."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table, tidy
from tidemark.llm.urls import host_of
from tidemark.session import cut

LEAST_PAGES = 3  # same-host pages of different text that must share a token before it can belong to the template
SHARE = 0.5  # and their share of the host's such pages: a host has at most 1 / SHARE times the tokens of a mean page

# Element names of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())
_DROPPED = frozenset("nav footer aside form menu dialog select button datalist head".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promoted promotion sidebar sidenav menu submenu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification banner popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social comment comments disqus respond reply replies related recommended recommendations footer "
    "masthead toolbar pagination pager skip alert paywall widget".split())
# words that may stand beside a mark in a name that is a known boilerplate name as a whole
_BOXES = frozenset(
    "after area article bar before block body bottom box btn button buttons container content entry form group header icon icons inline inner item items "
    "label left link links list main outer page panel post posts articles stories right row section site slot thread title tools top unit wp wrap wrapper".split())
_HEADER = frozenset(("header", "masthead", "topbar"))
_CONTENT_MARKS = frozenset("articlebody content maincontent article post entry story".split())

_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre blockquote figcaption summary".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</(?![A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|[^<]+|<(?![A-Za-z/])", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    """A piece of text with the block it is part of and where it stands."""

    block: int
    text: str
    token: int  # hash of path and text
    position: int
    dropped: bool  # inside an element that never holds the article
    inside: frozenset  # which of article, main, content it stands in
    doubtful: frozenset = frozenset()  # elements around it, in an article, of whose names only a part tells of boilerplate
    held: bool = False  # inside a heading, paragraph, list item, table cell or other element of prose
    linked: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)  # hashes of tags with their path, and of texts, in page order


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip(" /\n\t") else {}


def _marks(at: dict[str, str]) -> set[str]:
    return {p.lower() for p in _PART.split(f"{at.get('class', '')} {at.get('id', '')}") if p}


def _known(at: dict[str, str], marks: frozenset) -> bool:
    """Whether a class or the id is a boilerplate name as a whole: marks, numbers and words for boxes."""
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        parts = {p.rstrip("0123456789") for p in _marks({"class": name})} - {""}
        if parts & marks and parts <= marks | _BOXES:
            return True
    return False


_KEPT, _FORM, _GONE = 0, 1, 2  # an element's text: stays, goes unless an article follows inside, goes


def _drops(tag: str, at: dict[str, str], inside: frozenset) -> int:
    """What an element does to its text. Names count as a whole, so that a layout with a sidebar is no sidebar."""
    if tag in _DROPPED:
        return _FORM if tag == "form" else _GONE
    if tag in ("html", "body", "article", "main"):
        return _KEPT
    in_article = bool(inside & {"article", "main"})
    if tag == "header" and not in_article:
        return _GONE
    if not at:
        return _KEPT
    style = at.get("style", "").replace(" ", "").lower()
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return _GONE
    if at.get("role", "").lower() in _ROLES:
        return _GONE
    return _GONE if _known(at, _MARKS if in_article else _MARKS | _HEADER) else _KEPT


def parse(source: str | None) -> Page:
    """Texts and tag tokens of a page. Unclosed, crossed and stray tags are met as browsers meet them."""
    page, block = Page(), 0
    # open elements: name, path hash, dropped, inside, doubtful, held, linked
    stack: list[tuple[str, int, int, frozenset, frozenset, bool, bool]] = [("", 0, _KEPT, frozenset(), frozenset(), False, False)]
    text, digest = source or "", xxhash.xxh64_intdigest
    at, end = 0, len(text)
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:  # an unfinished tag at the end of the page
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if text.startswith(("<!", "<?", "</"), m.start()):  # comments, as browsers take an end tag without a name for one
                continue
            _, path, dropped, inside, doubtful, held, linked = stack[-1]
            words = _SPACE.sub(" ", unescape(m[0]))
            token = digest(words.strip().encode("utf-8", "surrogatepass"), path)
            if words != " ":
                page.tokens.append(token)
            page.nodes.append(Node(block, words, token, len(page.tokens), dropped > 0, inside, doubtful, held, linked))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK:
                block += 1
            names = [s[0] for s in stack]
            if tag in names[1:]:
                page.tokens.append(digest(b"/" + tag.encode(), stack[len(names) - 1 - names[::-1].index(tag)][1]))
                del stack[len(names) - 1 - names[::-1].index(tag):]
            continue
        closes = {"p"} if tag in _CLOSES_P else _SIBLINGS.get(tag, ())
        for depth in range(len(stack) - 1, 0, -1) if closes else ():
            if stack[depth][0] in closes:
                del stack[depth:]
                break
            if stack[depth][0] in _SCOPE:
                break
        if tag in _BLOCK:
            block += 1
        _, path, dropped, inside, doubtful, held, linked = stack[-1]
        attributes = _attributes(m[3])
        key = digest(f"{tag} {attributes.get('class', '')} {attributes.get('id', '')}".encode("utf-8", "surrogatepass"), path)
        page.tokens.append(key)
        if tag == "br":
            page.nodes.append(Node(block, " ", 0, len(page.tokens), dropped > 0, inside, doubtful, held, linked))
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        if attributes and inside & {"article", "main"} and tag not in ("article", "main") and _marks(attributes) & _MARKS:
            doubtful = doubtful | {key}
        if tag in ("article", "main") or attributes.get("role") == "main":
            inside = inside | {"article" if tag == "article" else "main"}
        elif attributes and ("articleBody" in attributes.get("itemprop", "") or {"".join(_marks({"class": c})) for c in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()} & _CONTENT_MARKS):
            inside = inside | {"content"}
        before = stack[-1][3]
        if dropped == _FORM and inside != before and not before:
            dropped = _KEPT  # a form around the whole page is its frame
        stack.append((tag, key, max(dropped, _drops(tag, attributes, before)), inside, doubtful, held or tag in _PROSE, linked or tag == "a"))
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = stop.start() if stop else end
    return page


@dataclass
class EquivalenceClass:
    """Tokens with one occurrence vector, in page order; `children` nest in its slots (slot i ends at token i)."""

    tokens: list[int]
    spots: list[float]
    slot: int = 0
    children: list[EquivalenceClass] = field(default_factory=list)


def nest(tokens: list[tuple[int, int, float]]) -> list[EquivalenceClass]:
    """(token, vector, mean position) of a host -> the outer classes of its template.

    A class is valid if it lies within one slot of the class around it or apart from it; one that crosses another
    of more tokens is no part of the template.
    """
    by_vector: dict[int, list] = defaultdict(list)
    for token, vector, spot in tokens:
        by_vector[vector].append((spot, token))
    classes = []
    for members in by_vector.values():
        members.sort()
        classes.append(EquivalenceClass([t for _, t in members], [s for s, _ in members]))
    classes.sort(key=lambda c: (-len(c.tokens), c.spots[0], c.tokens[0]))
    outer: list[EquivalenceClass] = []

    def place(new: EquivalenceClass) -> None:
        level = outer
        while True:
            around = next((c for c in level if new.spots[0] <= c.spots[-1] and new.spots[-1] >= c.spots[0]), None)
            if around is None:
                level.append(new)
                return
            slot = np.searchsorted(around.spots, [new.spots[0], new.spots[-1]])
            if slot[0] != slot[1] or not 0 < slot[0] < len(around.spots):
                return
            new.slot, level = int(slot[0]), around.children

    for c in classes:
        place(c)
    return outer


def template_tokens(page: Page, outer: list[EquivalenceClass]) -> set[int]:
    """Tokens of the classes that hold on this page: all tokens there, in the class's order, inside the parent's slot."""
    first: dict[int, int] = {}
    for i, t in enumerate(page.tokens):
        first.setdefault(t, i)
    found: set[int] = set()

    def holds(c: EquivalenceClass, low: int, high: int) -> list[int]:
        at = [first.get(t, -1) for t in c.tokens]
        return at if all(low <= x <= high for x in at) and all(x < y for x, y in zip(at, at[1:])) else []

    todo = [(c, 0, len(page.tokens)) for c in outer]
    while todo:
        c, low, high = todo.pop()
        if at := holds(c, low, high):
            found.update(c.tokens)
            todo += [(child, at[child.slot - 1], at[child.slot]) for child in c.children]
    return found


def main_text(page: Page, template: set[int]) -> str:
    """Blocks of the article, white space in one space, joined by an empty line.

    Content is the article (a main element, a content element), or on a page without such an element what stands in the
    template's slots outside dropped elements. In an article the template takes away only what is neither prose (a
    heading, paragraph, list item, cell: such text recurs in articles too) nor between prose: text of other elements
    at the article's edge, or in links; and elements of whose class or id only a part tells of boilerplate
    ("related-teasers").
    """
    nodes = [n for n in page.nodes if not n.dropped and n.doubtful.isdisjoint(template)]
    words = lambda some: any(n.text.strip() for n in some)
    inner = [n for n in nodes if {"article", "main"} <= n.inside]
    for chosen in (inner, [n for n in nodes if "article" in n.inside], [n for n in nodes if "main" in n.inside], [n for n in nodes if "content" in n.inside]):
        if words(chosen):
            loose = [n.token in template and not n.held or not n.text.strip() for n in chosen]
            first = next((i for i, x in enumerate(loose) if not x), len(chosen))
            last = next((i for i in range(len(chosen) - 1, -1, -1) if not loose[i]), -1)
            chosen = [n for i, n in enumerate(chosen) if not (loose[i] and n.text.strip() and (n.linked or first <= last and not first < i < last))]
            break
    else:
        chosen = [n for n in nodes if n.token not in template]
    blocks: list[list[str]] = []
    last = None
    for n in chosen:
        if n.block != last:
            blocks.append([])
            last = n.block
        blocks[-1].append(n.text)
    joined = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(b for b in joined if b)


def _occurrences(batches):
    """Tokens of every page, and token 0, with a hash of its text and one of (text, count), the page's part of the token's occurrence vector."""
    for pdf in batches:
        hosts, tokens, articles, parts, spots = [], [], [], [], []
        for host, source in zip(pdf["host"], pdf["html"]):
            page = parse(source)
            article = xxhash.xxh64_intdigest(main_text(page, set()).encode("utf-8", "surrogatepass"))
            first: dict[int, int] = {0: 0}
            count: dict[int, int] = defaultdict(int)
            for i, t in enumerate(page.tokens):
                first.setdefault(t, i)
                count[t] += 1
            hosts += [host] * len(first)
            tokens += first
            articles += [article] * len(first)
            parts += [xxhash.xxh64_intdigest(str(count[t]), article) for t in first]
            spots += first.values()
        yield pd.DataFrame({"host": hosts, "token": np.array(tokens, np.uint64).view(np.int64), "article": np.array(articles, np.uint64).view(np.int64), "part": np.array(parts, np.uint64).view(np.int64), "spot": np.array(spots, np.int64)})


def _extract(batches):
    memo: dict[str, list[EquivalenceClass]] = {}
    for pdf in batches:
        texts = []
        for host, source, template in zip(pdf["host"], pdf["html"], pdf["template"]):
            page = parse(source)
            if host not in memo:
                if len(memo) > 10_000:
                    memo.clear()
                memo[host] = [] if template is None else nest([(int(np.int64(r["token"]).view(np.uint64)), r["vector"], r["spot"]) for r in template])
            texts.append(main_text(page, template_tokens(page, memo[host])))
        yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts})


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, template): per host the tokens on at least `share` of its pages, with occurrence vector and mean position.

    Pages of equal text count as one, so copies of an article are no template. A token's occurrence vector over the
    host's pages is kept as the xor of a hash of text and count; a hot host is dealt by token and text.
    """
    counted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter(F.col("html").isNotNull() & (F.col("host") != ""))
    seen = counted.mapInPandas(tidy(_occurrences), "host string, token long, article long, part long, spot long")
    once = seen.groupBy("host", "token", "article").agg(F.min("part").alias("part"), F.min("spot").alias("spot"))
    tokens = once.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.bit_xor("part").alias("vector"), F.avg("spot").alias("spot"))
    kept = cut(tokens.filter(F.col("pages") >= least), "tokens")  # token 0 counts the host's pages
    sizes = kept.filter(F.col("token") == 0).select("host", F.col("pages").alias("size"))
    common = kept.filter(F.col("token") != 0).join(sizes, "host").filter(F.col("pages") >= F.col("size") * F.lit(share))
    return common.groupBy("host").agg(F.collect_list(F.struct("token", "vector", "spot")).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, `text` (empty if none) and `n_chars`.

    Tags and texts are tokens under their element path. Tokens with equal occurrence vectors over the pages of a host
    form a class; classes that hold together on a page and nest are the template, what stands in its slots is content,
    within an article too.
    Menus, page headers, footers, sidebars, notices, adverts, forms, scripts and reader comments are told by element,
    role, class and id. Null html gives an empty text; null ids and repeated rows are kept; pages without host (null
    url) have no template, as nothing says that they belong together. Other columns are ignored, whatever their names.

    The templates are stored and join on host without a hint: while their files are below Spark's threshold they are
    broadcast and no page moves, else both sides are dealt by host and AQE splits a hot one.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    joined = rows.join(cut(templates(pages, url_col, html_col), "templates"), "host", "left").select("id", "url", "host", "html", "template")
    out = joined.mapInPandas(tidy(_extract), "id string, url string, text string")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))

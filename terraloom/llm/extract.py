"""Main text of published lesson pages.

Method: consensus of a host's pages.  Each page scores its containers and votes for the
path (tags and classes without numbers) of the smallest one that holds most of its running
text, widened to the article around it.  Votes are counted per host in Spark, and every page
is then read again with the winning path of its host; a page that lacks it, or keeps little
text there, uses its own vote.

Tags, roles and hidden elements leave text out for certain.  A class or id only makes an
element suspect, and only if it speaks of nothing else; what is suspect comes back where it
holds an article, or where the page has little other running text.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import bpe
from terraloom.llm import words as w
from terraloom.scale import materialize

MOST = 0.75  # share of the running text that a page's container must hold
LEAST = 0.25  # share below which the host's container is not used

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg canvas select button object math audio video title".split())
BLOCK = set(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre header footer "
    "nav aside figure figcaption form fieldset address hr details summary center dialog menu".split())
CONTAINER = set("body main article section div td blockquote form header footer nav aside center details dialog".split())
LEFT_OUT = set("head nav aside footer form dialog menu fieldset".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in class and id names of what is not the article.
WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead "
    "footer sidebar rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist discussion disqus respond replies search pagination pager "
    "copyright legal disclaimer toolbar skip teaser teasers outbrain taboola paywall".split())
HEADER_WORDS = {"header", "topbar"}
NOT_ABOUT_ITSELF = {"has", "with", "no", "without", "is", "not"}
#: Words that say nothing about the contents; a name of one of these and of WORDS only is suspect.
NEUTRAL = set(
    "area bar block body bottom box btn button buttons column container content global group inner item items left link links list main outer page panel "
    "post posts primary right row secondary section site small text title top unit wrap wrapper".split())
NEVER_SUSPECT = {"html", "body", "main", "article"}
HEAVY = 200  # hosts with more than one page in so many are joined by broadcast
CLOSED_BY = {  # an open element that a new one of these ends
    "p": BLOCK - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}


@dataclass
class Page:
    """Containers of a page (parent, path, running text, suspect element around or 0) and its blocks (container, text, suspect element)."""

    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[str] = field(default_factory=lambda: [""])
    weights: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    suspect: list[int] = field(default_factory=lambda: [0])  # running text of each suspect element; 0 stands for none
    holds_article: set[int] = field(default_factory=set)  # suspect elements around an article
    running: list[tuple[int, int, int]] = field(default_factory=list)  # container, suspect element, running text of each block


def _names(tag: str, attributes: str) -> tuple[list[str], bool, bool]:
    """Class names without numbers, whether the element is left out, and whether its names make it suspect."""
    classes, out, suspect = [], False, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out = True
        elif name == "role":
            out |= value.lower() in ROLES
        elif name in ("class", "id"):
            for word in value.split():
                parts = _PART.findall(_CAMEL.sub(" ", word).lower())
                about = parts[: next((k for k, p in enumerate(parts) if p in NOT_ABOUT_ITSELF), len(parts))]
                if about and tag not in NEVER_SUSPECT and all(p in WORDS or p in NEUTRAL or p in HEADER_WORDS for p in about):
                    suspect |= any(p in WORDS for p in about) or about[0] in HEADER_WORDS and len(about) == 1 or about in (["page", "header"], ["site", "header"])
                if name == "class" and parts and tag != "body":  # a body's classes often tell pages apart
                    classes.append("-".join(parts))
    return sorted(set(classes)), out, suspect


def parse(text: str) -> Page:
    """Tolerant reading of a page: unclosed and crossing tags, truncated ends, raw elements."""
    page = Page()
    stack: list[tuple[str, int, bool, bool, int]] = []  # tag, container, left out, in an article, suspect element around
    buffer: list[str] = []
    link = links = 0  # depth of links; their characters in the buffer
    at, end = 0, len(text)

    def flush() -> None:
        nonlocal links
        if buffer:
            block = " ".join(markup.unescape("".join(buffer)).split())
            _, container, out, _, mark = stack[-1] if stack else ("", 0, False, False, 0)
            if block and not out:
                page.blocks.append((container, block, mark))
                page.running.append((container, mark, max(0, len(block) - links)))
            buffer.clear()
        links = 0

    def pop_to(k: int) -> None:
        flush()
        del stack[k:]

    while at < end:
        m = _TAG.search(text, at)
        piece = text[at : m.start() if m else end]
        if piece:
            buffer.append(piece)
            if link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            buffer.append(" ")
        elif closing:
            if tag in BLOCK:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
                if k >= 0:
                    pop_to(k)
                else:
                    flush()
        elif tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(text, at)
                at = close.end() if close else end
        elif tag in BLOCK and tag not in VOID:
            flush()
            link = 0
            for open_, closers in CLOSED_BY.items():
                if tag in closers:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == open_:
                            pop_to(k)
                            break
                        if stack[k][0] in STOPS.get(open_, CONTAINER):
                            break
            _, parent, out, inside, mark = stack[-1] if stack else ("", 0, False, False, 0)
            classes, other, suspect = _names(tag, attributes) if attributes else ([], False, False)
            if tag in ("article", "main"):
                inside = True
                page.holds_article.update(x[4] for x in stack)
            if suspect and not mark:
                mark = len(page.suspect)
                page.suspect.append(0)
            out |= other or tag in LEFT_OUT or tag == "header" and not inside
            container = parent
            if tag in CONTAINER:
                container = len(page.parents)
                page.parents.append(parent)
                page.paths.append(f"{page.paths[parent]}>{'.'.join([tag, *classes])}")
                page.weights.append(0)
            stack.append((tag, container, out, inside, mark))
        elif tag == "hr":
            flush()
    flush()
    return _judged(page)


def _judged(page: Page) -> Page:
    """Leave out the blocks of suspect elements, but for those around an article and, where little else has running text, the largest."""
    for _, mark, n in page.running:
        page.suspect[mark] += n
    whole = sum(page.suspect)
    largest = max(page.suspect[1:], default=0) if page.suspect[0] < (1 - MOST) * whole else whole + 1
    out = {k for k, n in enumerate(page.suspect) if k and k not in page.holds_article and n < largest}
    page.blocks = [b for b in page.blocks if b[2] not in out]
    for container, mark, n in page.running:
        if mark not in out:
            page.weights[container] += n
    return page


def _totals(page: Page) -> list[int]:
    total = list(page.weights)
    for k in range(len(total) - 1, 0, -1):  # children come after their parents
        total[page.parents[k]] += total[k]
    return total


def vote(page: Page) -> str | None:
    """Path of the smallest container that holds most of the running text, or of the article around it."""
    total = _totals(page)
    if not total[0]:
        return None
    best = k = max((k for k in range(len(total)) if total[k] >= MOST * total[0]), key=lambda k: (page.paths[k].count(">"), -k))
    while k > 0:
        if _last(page.paths[k]) in ("article", "main"):
            return page.paths[k]
        k = page.parents[k]
    return page.paths[best]


def _last(path: str) -> str:
    """Tag of the innermost element of a path."""
    return path.rpartition(">")[2].partition(".")[0]


def _same(own: str, path: str) -> bool:
    """Whether a container is one that the path names: articles side by side are one article in parts, whatever their classes."""
    return own == path or _last(path) == "article" == _last(own) and own.rpartition(">")[0] == path.rpartition(">")[0]


def text_in(page: Page, path: str | None) -> tuple[str, int]:
    """Blocks within the containers of a path that have running text, and how much they have."""
    inside, total = [False] * len(page.parents), _totals(page)
    for k, own in enumerate(page.paths):
        inside[k] = path is not None and _same(own, path) and total[k] > 0 or k > 0 and inside[page.parents[k]]
    return "\n\n".join(t for k, t, _ in page.blocks if inside[k]), sum(x for k, x in enumerate(page.weights) if inside[k])


def main_text(text: str, path: str | None) -> tuple[str, str | None]:
    """Main text of a page given its host's path, and the path that was used."""
    page = parse(text)
    own = vote(page)
    if path is not None and path != own:
        found, weight = text_in(page, path)
        if weight and weight >= LEAST * sum(page.weights):
            return found, path
    if own is None:  # nothing but links, or nothing at all
        return "\n\n".join(t for _, t, _ in page.blocks), None
    return text_in(page, own)[0], own


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host``, its winning ``path`` (most votes, then the shorter and first one by name) and its number of ``votes``."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bpe.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({
                    "host": part.column(0), "path": pa.array([vote(parse(t)) if t else None for t in part.column(1).to_pylist()], pa.string())})

    cast = pages.select(host_of("url").alias("host"), "html").mapInArrow(w.tidy(votes), "host string, path string").where("path is not null")
    counts = cast.groupBy("host", "path").agg(F.count("*").alias("votes"))
    return counts.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.length("path"), "path")).alias("path"), F.sum("votes").alias("votes"))


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of each lesson page.

    pages: ``page_id`` bigint, ``url`` and ``html`` string; further columns are not read.
    Returns ``page_id``, ``url``, ``text``, ``n_chars`` (code points) and ``path``, the
    container path that was used.  Blocks are joined by an empty line, white space within a
    block is one space, character references are decoded.  Menus, page headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are left out.  A null
    or empty html has an empty text; pages without a host vote together; repeated rows are
    kept.  An empty table gives an empty result.

    Pages of a host with many pages are not placed together: at most ``HEAVY`` such hosts
    are broadcast, all others are joined through a shuffle.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bpe.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                found = [main_text(t, p) if t else ("", None) for t, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "page_id": part.column(0), "url": part.column(1), "text": pa.array([t for t, _ in found], pa.string()),
                    "n_chars": pa.array([len(t) for t, _ in found], pa.int64()), "path": pa.array([p for _, p in found], pa.string())})

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of("url").alias("host"))
    paths = materialize(host_paths(pages))
    total = paths.agg(F.sum("votes").alias("n")).first()["n"] or 0
    heavy = paths.where(F.col("votes") * HEAVY > total)  # fewer than HEAVY rows
    others = paths.join(F.broadcast(heavy.select("host")), "host", "left_anti")
    in_heavy = rows.join(F.broadcast(heavy), "host")
    rest = rows.join(F.broadcast(heavy.select("host")), "host", "left_anti").join(others, "host", "left")
    whole = in_heavy.unionByName(rest).select("page_id", "url", "html", "path")
    return whole.mapInArrow(
        w.tidy(extract), "page_id bigint, url string, text string, n_chars bigint, path string")

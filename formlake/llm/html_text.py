"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of words and tags. Words score by the block element they stand in, tags are
negative; both weights are log-odds learned from labelled pages, which are those whose markup
names the main element. One linear scan finds the contiguous region with the largest sum; the
region's blocks without those that score as boilerplate are the text.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share

SAMPLE_PAGES = 4_000  # labelled pages used to learn weights, at most about (chosen by hash of the id)
TAG_RANGE = (-10.0, -0.1)
WORD_RANGE = (-3.0, 1.0)
UNSEEN_WORD = 0.5
UNSEEN_TAG = -1.0
MEMO = 5_000          # signatures remembered by a worker

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                   "section table ul".split())
MAIN = frozenset(("article", "main"))
BARRIERS = MAIN | {"div", "section", "td"}  # a p outside of them is not ended by a block inside
REPEATED = frozenset("li dt dd option tr td th".split())
ROOTS = frozenset(("html", "body", "main", "article"))  # class names say nothing against them
# Elements whose content is no text; all but svg end at their own end tag only.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I)
       for t in "script style noscript template textarea select svg iframe".split()}
# Names by which pages mark what is not the article; the second list also names whole layouts and parts of articles.
STRONG = re.compile(r"\b(?:nav|menu|masthead|footer|aside|sidebar|side-?bar|cookie|consent|ads?|advert\w*"
                    r"|sponsor\w*|promo|comments?|respond|reply|replies|breadcrumbs?|pagination"
                    r"|newsletter|subscribe|login)\b", re.I)
WEAK = re.compile(r"\b(?:header|notice|banner|form|related|share|social|search)\b", re.I)
_LAYOUT = re.compile(r"(?:\S*-)?(?:has|with|without|no)-\S*", re.I)  # has-sidebar, page-with-banner: a layout, not a part

MARK = " !"           # ends the signature of a marked element; no name holds a space


class Signatures(dict):
    """all names of a tag, joined -> (signature: the first names, mark: 0 none, 1 weak, 2 strong), memoised within a bound."""

    def __missing__(self, full: str) -> tuple[str, int]:
        if len(self) > MEMO:
            self.clear()
        tag, *names = full.split(" ")
        said = " ".join([tag, *([] if tag in ROOTS else [n for n in names if not _LAYOUT.fullmatch(n)])])
        mark = 2 if tag == "title" or STRONG.search(said) else 1 if WEAK.search(said) else 0
        value = self[full] = ".".join([tag, *names[:4]])[:80], mark
        return value


_signatures = Signatures()


def _marked(sig: str) -> bool:
    return sig.endswith(MARK)


def _names(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    names = sorted({w.lower() for m in _CLASS.finditer(attributes) for g in m.groups() if g for w in g.split()})
    return " ".join([tag, *names])


def pieces(page: str):
    """(text, "", "") or ("", "/" of an end tag, tag, attributes) in page order, in one pass whatever the markup.

    A comment or an element without text runs to the end of the page where it is not closed. A quote
    that is never closed makes quotes count for nothing from there on; a "<" without any ">" after it is
    skipped with its name left as text.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            yield page[at:start], "", "", ""
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = end + 3 if end >= 0 else len(page)
            continue
        if start >= last:
            continue
        if page[at] in "!?":
            at = page.index(">", at) + 1
            continue
        m = _TAG.match(page, start)
        if m is None:
            continue
        rest = _ATTRIBUTES.match(page, m.end()) if quotes else None
        if rest is not None:
            attributes, at = rest.group(1), rest.end()
        else:
            quotes = False
            end = page.index(">", m.end())
            attributes, at = page[m.end():end], end + 1
        tag = m.group(2).lower()
        if tag not in RAW:
            yield "", m.group(1), tag, attributes
        elif not m.group(1) and not (tag == "svg" and attributes.endswith("/")):
            close = RAW[tag].search(page, at)
            at = close.end() if close else len(page)


class _Elements:
    """A page's elements in the order of their start tags, so that a parent's number is below its children's."""

    def __init__(self) -> None:
        self.parent, self.tag, self.sig, self.mark, self.words, self.shown, self.inside = [], [], [], [], [], [], []

    def add(self, parent: int, tag: str, names: str) -> int:
        sig, mark = _signatures[names]
        self.parent.append(parent)
        self.tag.append(tag)
        self.sig.append(sig)
        self.mark.append(mark)
        self.words.append(0)
        self.shown.append(tag in ("main", "h1"))
        self.inside.append(tag in MAIN or (parent >= 0 and self.inside[parent]))
        return len(self.tag) - 1

    def close(self, total: int) -> list[str]:
        """The container of each element's own words: its innermost marked ancestor, itself if there is none.

        A mark does not decide for an element with most of the page's words if it is weak or the element
        holds the main element or the page's heading; nor does a header's mark inside the main element.
        """
        for i in range(len(self.tag) - 1, -1, -1):
            p = self.parent[i]
            if p >= 0:
                self.words[p] += self.words[i]
                self.shown[p] |= self.shown[i]
        held: list[str] = []
        for i, (p, sig) in enumerate(zip(self.parent, self.sig)):
            mark = self.mark[i]
            if mark and (2 * self.words[i] > total and (mark == 1 or self.shown[i]) or
                         (mark == 1 and self.tag[i] == "header" and self.inside[i])):
                mark = 0
            if mark:
                self.sig[i] = sig + MARK
            held.append(held[p] if p >= 0 and not mark and _marked(held[p]) else self.sig[i])
        return held


def tokens(page: str, main_tags: frozenset = MAIN) -> list[tuple[int, str, str, bool, int]]:
    """(kind, value, container, in main, words) in page order: kind 0 a text, 1 a tag that breaks blocks, 2 an inline tag."""
    elements = _Elements()
    stack: list[tuple[str, int, int]] = []  # tag, element, place of the p that a block ends (-1: none)
    open_tags: dict[str, int] = {}
    found: list[tuple] = []
    main, top, total = 0, -1, 0

    def pop() -> tuple[str, int, int]:
        nonlocal main
        gone = stack.pop()
        open_tags[gone[0]] -= 1
        main -= gone[0] in main_tags
        return gone

    for text, end, tag, attributes in pieces(page):
        if text:
            n = len(text.split())
            total += n
            if top >= 0:
                elements.words[top] += n
            found.append((0, text, top, main > 0, n))
            continue
        if tag in INLINE:
            found.append((2, tag, top, main > 0, 1))
            continue
        if end:
            own = -1
            if open_tags.get(tag):
                while own < 0:
                    t, i, _ = pop()
                    own = i if t == tag else -1
            top = stack[-1][1] if stack else -1
            found.append((1, tag if own < 0 else own, top, main > 0, 1))
            continue
        if tag in ENDS_P and stack and stack[-1][2] >= 0:
            for _ in range(len(stack) - stack[-1][2]):
                pop()
        elif tag in REPEATED and stack and stack[-1][0] == tag:
            pop()
        own = elements.add(stack[-1][1] if stack else -1, tag, _names(tag, attributes))
        if tag not in VOID:
            inner = len(stack) if tag == "p" else -1 if tag in BARRIERS or not stack else stack[-1][2]
            stack.append((tag, own, inner))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            main += tag in main_tags
            top = own
        found.append((1, own, top, main > 0, 1))
    held = elements.close(total)
    return [(kind, elements.sig[value] if type(value) is int else value, held[at] if at >= 0 else "", inside, n)
            for kind, value, at, inside, n in found]


def labelled_by(page: str) -> str | None:
    """The element by which the page's markup names its main text: its only article, else its only main element."""
    for tag in ("article", "main"):
        if len(re.findall(rf"<{tag}\b", page, re.I)) == 1:
            return tag
    return None


def counts(page: str) -> dict[str, list[int]]:
    """signature -> [inside, outside] of the main element, for words (``w:``) and tags (``t:``)."""
    out: dict[str, list[int]] = {}
    named = labelled_by(page)
    for kind, value, container, inside, n in tokens(page, frozenset((named,)) if named else MAIN):
        key = "w:" + container if kind == 0 else "t:" + value
        if n:
            out.setdefault(key, [0, 0])[0 if inside else 1] += n
    return out


def learn_weights(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html",
                  sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds of words' containers and of tags, from a bounded sample of labelled pages."""
    text = F.col(html_col).cast("string")
    labelled = pages.select(F.col(id_col).cast("string").alias("id"), text.alias("html")).where(
        (F.regexp_count("html", F.lit("(?i)<article\\b")) == 1) | (F.regexp_count("html", F.lit("(?i)<main\\b")) == 1))
    key = F.xxhash64("id", "html")
    picked = labelled.where(hash_share(key, sample_pages, labelled.count()))

    def run(batches):
        for batch in batches:
            total: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                for key, (a, b) in counts(page).items():
                    t = total.setdefault(key, [0, 0])
                    t[0] += a
                    t[1] += b
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()),
                                              pa.array([v[1] for v in total.values()], pa.int64())], names=["key", "a", "b"])

    rows = (picked.select("html").mapInArrow(run, "key string, a long, b long").groupBy("key").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).collect())  # the sampled pages' signatures
    weights = {}
    for kind, (low, high) in (("w:", WORD_RANGE), ("t:", TAG_RANGE)):
        mine = [r for r in rows if r["key"].startswith(kind)]
        inside, outside = sum(r["a"] for r in mine) + 1, sum(r["b"] for r in mine) + 1
        for r in mine:
            odds = math.log((r["a"] + 0.5) / inside) - math.log((r["b"] + 0.5) / outside)
            weights[r["key"]] = min(high, max(low, 2 * odds))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest positive sum; the first such, (0, 0) if none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, one a line."""
    found = tokens(page)
    scores, keep = [], []
    for kind, value, container, _, n in found:
        if kind == 0:
            w = weights.get("w:" + container)
            if w is None or _marked(container):
                prior = WORD_RANGE[0] if _marked(container) else UNSEEN_WORD
                w = prior if w is None else min(w, prior) if abs(w) < 0.5 else w
            scores.append(w * n)
            keep.append(w > 0)
        else:
            scores.append(weights.get("t:" + value, UNSEEN_TAG) if kind == 1 else TAG_RANGE[1])
            keep.append(False)
    a, b = best_region(scores)
    blocks, block = [], []
    for i in range(a, b):
        kind, value = found[i][:2]
        if kind == 0 and keep[i]:
            block.append(html.unescape(value))
        elif kind == 1 and block:
            blocks.append(" ".join("".join(block).split()))
            block = []
    blocks.append(" ".join("".join(block).split()))
    return "\n".join(x for x in blocks if x)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      weights: dict[str, float] | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points).

    A null, empty or wordless page gives an empty text; null ids and urls are kept, repeated rows
    give a row each. Pages of any length and any broken markup are read whole, in one pass. An empty table
    gives no rows; columns of other names are never read. Without labelled pages the
    names of the markup alone decide.
    """
    learned = learn_weights(pages, id_col=id_col, html_col=html_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [main_text(p or "", learned) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

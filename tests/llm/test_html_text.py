"""Main text: broken markup in one pass, names that mark layouts, an article's own heading, the region by brute force."""

from __future__ import annotations

import random
import time

import pytest

from formlake.llm.html_text import best_region, extract_main_text, labelled_by, main_text, pieces, tokens

WORDS = " ".join(["word"] * 200)


@pytest.mark.parametrize("unit", ["<script ", "<p a='b \"", "<div>", "<p><td>", "<ul>", "<!", "</script", "<a b=\">\"", "<svg><svg/>", "<x y='>"])
@pytest.mark.parametrize("tail", ["", ">"])
def test_long_broken_markup_takes_one_pass(unit, tail):
    started = time.time()
    main_text(unit * (1_000_000 // len(unit)) + tail, {})
    assert time.time() - started < 20  # hours with a rescan per tag


def test_pieces():
    assert [p[0] or p[1:] for p in pieces("a<b x='>'>c</b><!-- <p> --><script>if (a<b) </SCRIPT >d<?php ?>e<svg/>f<svg><p></svg>g< h")] == [
        "a", ("", "b", " x='>'"), "c", ("/", "b", ""), "d", "e", "f", "g", " h"]
    assert [p[0] or p[2] for p in pieces("<p a='b>c<i>d")] == ["p", "c", "i", "d"]  # a quote never closed counts for nothing
    assert list(pieces("x<!-- y")) == [("x", "", "", "")] and list(pieces("")) == []


@pytest.mark.parametrize("page", [
    '<body class="has-sidebar"><p>%s</p></body>', '<main class="layout with-sidebar"><p>%s</p></main>',
    '<div class="page-with-banner"><p>%s</p></div>', '<form id="aspnetForm"><p>%s</p></form>',
    '<div class="search-page related"><p>%s</p></div>', '<div class="sidebar-layout"><main><p>%s</p></main></div>',
    '<div class="header">menu</div><p>%s</p><div class="comments"><p>' + 2 * WORDS + "</p></div>"])
def test_names_of_layouts_do_not_empty_a_page(page):
    assert main_text(page % WORDS, {}) == WORDS


def test_own_heading_of_an_article_stays(spark):
    page = ('<body class="has-sidebar"><header><div class="title">Site name here</div></header><main><article><header><h1 class="entry-title">Heading {0}</h1>'
            "</header><p>" + WORDS + '</p></article><aside><p>Other things to read</p></aside></main><footer>All of us</footer></body>')
    df = spark.createDataFrame([(i, "u", page.format(i)) for i in range(20)] * 2, "page_id long, url string, html string")
    got = extract_main_text(df).collect()
    assert len(got) == 40 and all(r.text == f"Heading {r.page_id}\n{WORDS}" and r.n_chars == len(r.text) for r in got)
    assert extract_main_text(df, weights=None).where("text = ''").count() == 0
    assert [labelled_by(p) for p in (page, "<main></main>", "<main><article></article><article></article></main>", "<article>", "<p>")] == [
        "article", "main", "main", "article", None]


def test_region_by_brute_force():
    rnd = random.Random(5)
    for _ in range(500):
        scores = [rnd.choice([-3.0, -1.0, -.5, .5, 1.0, 2.0]) for _ in range(rnd.randrange(0, 14))]
        sums = [(sum(scores[i:j])) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        a, b = best_region(scores)
        assert sum(scores[a:b]) == max([0.0, *sums])


def test_containers_by_walking_the_stack():
    rnd = random.Random(7)
    tags = ["div", "p", "ul", "li", "section", "article", "td", "h2"]  # no main or h1, which can unmark a nav
    for _ in range(300):
        page = "".join(rnd.choice([f"<{rnd.choice(tags)}>", f"</{rnd.choice(tags)}>", "w ", "<nav>", "</nav>"]) for _ in range(40))
        stack, expected = [], []
        for text, end, tag, _ in pieces(page):
            if text:
                marked = [t for t in stack if t == "nav"]
                expected.append("nav !" if marked else stack[-1] if stack else "")
            elif end:
                if tag in stack:
                    while stack.pop() != tag:
                        pass
            else:
                if tag not in ("td", "li") and "p" in stack:
                    i = max(k for k, t in enumerate(stack) if t == "p")
                    if not {"article", "main", "div", "section", "td"} & set(stack[i:]):
                        del stack[i:]
                elif tag in ("td", "li") and stack and stack[-1] == tag:
                    stack.pop()
                stack.append(tag)
        got = [t[2] for t in tokens(page) if t[0] == 0]
        assert got == expected

"""Main text of pages: the fixture's articles, and pages by hand."""

import html
import re
import time

import numpy as np
import pytest

from tessitura.llm.html_text import extract_pages, main_text, smooth, split

LONG = "Long words of a real paragraph that goes on and on, with commas and so forth. " * 3


def test_fixture_articles(spark):
    for r in extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?!br)[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page,want", [
    ("", ""), ("<p>Short.</p>", "Short."), ("plain text", "plain text"),
    (f"<nav><a>Home</a></nav><div id=main><h2>T</h2><p>{LONG}<p>Hm &amp; &#233;.<p>{LONG}</div><div class='sidebar'><p>{LONG}</div><footer>{LONG}</footer>", f"T {LONG.strip()} Hm & é. {LONG.strip()}"),
    (f"<article><header><h1>A</h1></header><p>{LONG}</p><aside>no</aside><section class=comments><p>{LONG}</p></section><p>b<b>old</b>er<br>x</p></article>", f"A {LONG.strip()} bolder x"),
    (f"<header>Site</header><article><p>{LONG}</article><script>var a='<p>'</script><form><p>{LONG}</form>", LONG.strip()),
    ("<div class='ad-banner'>Buy</div><p hidden>no</p><p>Yes, here.</p>", "Yes, here."),
])
def test_pages_by_hand(page, want):
    assert main_text(page) == want


CARD = "<article><h3>Card</h3><p>A few words.</p></article>"
COMMENT = f"<article class='comment'><p>{LONG}</p></article>"


@pytest.mark.parametrize("page,want", [
    (f"<div class=body><h1>T</h1><p>{LONG}</p><p>Hm.</p><p>{LONG}</p></div>{CARD * 4}", f"T {LONG.strip()} Hm. {LONG.strip()}"),
    (f"{CARD * 4}<div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG.strip()} {LONG.strip()}"),
    (f"<main><div><p>{LONG}</p><p>{LONG}</p></div>{CARD * 2}</main>", f"{LONG.strip()} {LONG.strip()}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div>{COMMENT}", f"{LONG.strip()} {LONG.strip()}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>{LONG}</p></article>", " ".join([LONG.strip()] * 3)),
    (f"<article class='post category-social'><h1>A</h1><section><p>{LONG}</p></section><div><p>x</p></div></article><div>Few words</div>", f"A {LONG.strip()} x"),
])
def test_clusters_overrule_article_and_main(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("part,kept", [
    (f"<div class='warning'><p>{LONG}</p></div>", True), ("<p class='market share'>Shares rose by a third this year.</p>", True),
    ("<h2 id='search'>Search</h2>", True), (f"<section id='discussion'><p>{LONG}</p></section>", True), ("<div class='notice'><a href=x>Log in</a></div>", False),
    (f"<section class='comments'><p>{LONG}</p></section>", False), (f"<div class='advert'><p>{LONG}</p></div>", False), (f"<div id='newsletter-signup'><p>{LONG}</p></div>", False),
])
def test_names_inside_of_an_article(part, kept):
    text = re.sub("<[^>]*>", "", part).strip()
    got = main_text(f"<nav>Home</nav><article><h1>A</h1><p>{LONG}</p>{part}<p>{LONG}</p></article><footer>End</footer>")
    assert got == " ".join(["A", LONG.strip(), *([text] if kept else []), LONG.strip()])


@pytest.mark.parametrize("page", ["<div>" * 8000 + "x" + "</span>" * 8000, "<span>" * 8000 + "<p>x" * 2000, "<div><p>" * 8000 + "x" + "</b></p></i>" * 8000])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    assert main_text(page).startswith("x")
    assert time.process_time() - began < 3  # under half a second on an idle machine


def test_smoothing_and_clusters():
    assert np.allclose(smooth(np.full(5, 3.0), 1.0), 3)
    assert 1 < split(np.array([0.0, 1, 9, 10])) < 9
    assert split(np.array([4.0, 4.0])) == 4


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a", "x"), (1, "u", "<p>" + "w " * 100_000, "x")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in extract_pages(df).collect()) == [0, 1, 199_999]
    assert extract_pages(df.limit(0)).count() == 0

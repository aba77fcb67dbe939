"""Text inside the article is kept whole."""

import time

import pytest

from lakemill.llm.html import main_text

LONG = "A long sentence, with commas, and many words, so that it scores well, again and again. " * 5
PAGES = [
    (f"<article><p>{LONG}</p><p><a href=x>One linked sentence.</a></p><ol><li><a href=y>Reference</a></ol><table><tr><td><a href=z>Name</a></table></article>", ["One linked sentence.", "Reference", "Name"]),
    (f"<article><section><p>{LONG}</p></section><section><p>Short closing.</p></section></article>", ["Short closing."]),
    (f"<main><div><p>{LONG}</p></div><div><p>Short closing.</p></div></main><footer>no</footer>", ["Short closing."]),
    (f"<body><div class=content><p>{LONG}</p></div><ul><li>Item</ul><dl><dt>Term<dd>Sense</dl><ul><li><a href=x>Home</a></ul></body>", ["Item", "Term", "Sense"]),
    (f"<article><p>{LONG}</p><ul class=nav><li><a href=x>Home</a></ul></article>", []),
]


@pytest.mark.parametrize("source, rest", PAGES, ids=range(len(PAGES)))
def test_whole_article(source, rest):
    assert main_text(source) == "\n".join([LONG.strip(), *rest])


CASES = [
    ("<html><head><title>t</title><body><article><p>A head, left open.</p></article>", "A head, left open."),
    ("<head><title>t</title><p>No body, either.", "No body, either."),
    ("<head><meta charset=x><title>t</title>Bare, text.", "Bare, text."),
    ("<article><p>One, <a href='x>broken.</p><p>Two, three.</p></article>", "One, broken.\nTwo, three."),
    ("<article><b><div><i>in</b> it, all</i></div><ul><li>a<li>b</ul></article>", "in it, all\na\nb"),
]


@pytest.mark.parametrize("source, want", CASES, ids=range(len(CASES)))
def test_broken_markup(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("source", ["<a href='" * 110_000, "<i>" * 150_000 + "</b>" * 150_000, "<b><div>" + "<i>" * 150_000 + "</b>" * 150_000, "<i>" * 150_000 + "<hr>" * 150_000, "<div>" * 100_000 + "<li></li>" * 60_000, '<p class="' * 100_000], ids=range(6))
def test_linear_time(source):
    begin = time.process_time()
    main_text(source)
    assert time.process_time() - begin < 8


def test_odd_pages(spark):
    from lakemill.llm.html import extract_text

    page = "<article><p>Kept, whole.</p></article>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (3, "v", "")], "page_id long, url string, html string").selectExpr("*", "0 as text", "0 as n_chars")
    got = sorted(map(tuple, extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "Kept, whole.", 12), (1, "u", "Kept, whole.", 12), (None, None, "", 0), (3, "v", "", 0)], key=str)
    assert extract_text(pages.limit(0)).count() == 0

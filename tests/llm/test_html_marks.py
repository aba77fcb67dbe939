"""Marks of main text: attributes, class words inside articles, split articles, unclosed raw text; scores by brute force."""

import time

import pytest

from lakemill.llm import html

LONG = "Long text, with words, and more of them. " * 20


@pytest.mark.parametrize("attribute", ['title="a hidden b"', "title='x class=ad y'", 'data-x="style=display:none" data-hidden-by="no"', 'alt="role=dialog"', 'title="1 > 2 hidden"', "class=story title=\"hidden\""])
def test_words_inside_values_are_not_attributes(attribute):
    assert html.main_text(f"<p {attribute}>keep</p>") == "keep"


@pytest.mark.parametrize("attribute", ["hidden", 'HIDDEN=""', 'aria-hidden="TRUE"', "style='color:red;Display : NONE'", 'role="Navigation"', 'class="x ad"', "id=cookie-bar", 'title="x"hidden'.replace('"h', '" h')])
def test_marks_are_found(attribute):
    assert html.main_text(f"<body><div><p>{LONG}</p><p {attribute}>drop</p></div></body>") == LONG.strip()


def test_class_words_inside_an_article():
    kept = ["social science", "side-by-side", "related work", "content-tags", "notice-text", "share-of-voice", "ad-hoc-methods"]
    gone = ["related", "comments", "share-buttons", "ad", "newsletter box", "notice", "sidebar", "social", "cookie-text consent", "tags-list", "promo inner"]
    page = f"<article><p>{LONG}</p>" + "".join(f'<div class="{c}"><p>Words of {c}.</p></div>' for c in kept + gone) + '<div class="related work"><a href=1>All</a> <a href=2>linked</a></div></article>'
    assert html.main_text(page).split("\n")[1:] == [f"Words of {c}." for c in kept]


def test_split_articles_keep_short_parts():
    page = f"<body><div><h1>The title</h1></div><div><p>{LONG}</p><p>{LONG}</p></div><div><h2>End</h2><p>Short tail here.</p></div><div><p>Tiny.</p></div><div>Some mark</div><div><p><a href=x>Go</a></p></div></body>"
    assert html.main_text(page).split("\n") == ["The title", LONG.strip(), LONG.strip(), "End", "Short tail here.", "Tiny."]


def test_formulas_and_labels_are_text():
    page = f"<article><p>{LONG}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> and <label>this</label>.</p></article>"
    assert html.main_text(page).split("\n")[1] == "Let x=2 and this."


@pytest.mark.parametrize("part", ["</script ", "<script>", "</scrip", "<p class='", "<!--", "<a ", "<svg></svg ", "&amp"])
def test_a_megabyte_of_open_tags_takes_little_time(part):
    begin = time.process_time()
    html.main_text("<script>" + part * (1_000_000 // len(part)))
    html.main_text(f"<body><p>{LONG}" + part * (1_000_000 // len(part)))
    assert time.process_time() - begin < 4


def test_scores_of_small_trees_by_brute_force():
    page = "<body><div id=a><p>One, two, three.</p><div id=b><p>" + "x" * 250 + '</p><p><a href=1>linked, all</a></p></div></div><section id=c><p>Four.</p></section></body>'
    root = html.parse(page)
    html.best_containers(root)

    def text(x):
        return "".join(y if isinstance(y, str) else text(y) for y in x.children)

    def under(x):
        return [y for z in x.children if isinstance(z, html.Node) for y in (z, *under(z))]

    everything = [root, *under(root)]
    depth = lambda p, x: next((k for k, y in enumerate(chain(p), 1) if y is x), None)

    def chain(p):
        while p.parent is not None:
            p = p.parent
            yield p

    points = {}
    for p in (x for x in everything if x.tag == "p"):
        size = len(text(p))
        linked = sum(len(text(a)) for a in under(p) if a.tag == "a")
        points[id(p)] = (p, (1 + text(p).count(",") + min(size // 100, 3)) * (1 - linked / size))
    for x in everything:
        want = sum(n / k for p, n in points.values() if (k := depth(p, x)) and k <= 4)
        assert abs(x.score - want) < 1e-9

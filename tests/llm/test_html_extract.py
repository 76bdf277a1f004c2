import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm.html_extract import Rules, blocks, extract, main_text

PROSE = "This is the kind of sentence that you would find in an article, and it has a lot of the common words in it. " * 3
PROSE = PROSE.strip()
SHORT = "Sh is."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T & t</title><style>p{{a:b}}</style></head><body>{body}</body></html>"


CASES = {
    "article only": (f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{PROSE}</p><p>{SHORT}</p></article>", ["Head", PROSE, SHORT]),
    "left out by name": (
        f"<header>top {PROSE}</header><aside>{PROSE}</aside><article><p>{PROSE}</p></article><form>{PROSE}</form>"
        f"<footer>{PROSE}</footer><noscript>{PROSE}</noscript><script>var t='</p><p>{SHORT}</p>';</script>",
        [PROSE],
    ),
    "left out by class, id and role": (
        f"<article><div class='x ad-slot'>{PROSE}</div><p>{PROSE}</p><div id=comments><p>{PROSE}</p></div>"
        f"<div role='complementary'>{PROSE}</div><p hidden>{PROSE}</p><div style='display: none'>{PROSE}</div></article>",
        [PROSE],
    ),
    "comments as articles": (f"<article><p>{PROSE}</p><article class='comment'><p>{PROSE} no</p></article></article>", [PROSE]),
    "no article": (
        f"<div><a href=a>one</a> <a href=b>two</a></div><h2>Head</h2><p>{PROSE}</p><p>{SHORT}</p><p>{PROSE}</p><div>x | y</div>"
        "<div><a href=c>three</a></div><div>zz</div>",
        ["Head", PROSE, SHORT, PROSE],
    ),
    "references and white space": ("<article><p>a&amp;b &lt;i&gt;&nbsp;&#233;&#x41;\n\t c<br>d <b>e</b>f</p></article>", ["a&b <i> éA c d ef"]),
    "unclosed": (f"<article><p><b>{PROSE}<br><p>{SHORT}<li>x<li>y</article><p>{PROSE}", [PROSE, SHORT, "x", "y"]),
    "links inside an article": (f"<article><p>{PROSE}</p><p><a href=x>More of this</a></p><p>{SHORT}</p></article>", [PROSE, SHORT]),
    "only short blocks": ("<article><p>a</p><p>b c</p></article>", ["a", "b c"]),
    "comparison signs": ("<article><p>1 < 2 and 3 <4 > 0 <!-- no > --> yes</p></article>", ["1 < 2 and 3 <4 > 0 yes"]),
    "quoted signs": (f"<article><p title='a>b'>{SHORT}</p></article>", [SHORT]),
    "other words than stop words": (f"<article><p>{'lorem ipsum ' * 40}</p><p>{PROSE}</p></article>", [("lorem ipsum " * 40).strip(), PROSE]),
    "nothing": ("<nav>a</nav>", []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    body, want = CASES[name]
    assert main_text(page(body)).split("\n") == (want or [""])
    assert main_text(body).split("\n") == (want or [""])


def test_page_without_article_and_stop_words():
    long = " ".join("tämä lause kertoo jotain muuta kielellä jota ohjelma ei tunne".split() * 5)
    links = "<div><a href=a>yksi linkki vain</a> <a href=b>kaksi</a></div>"
    body = f"{links}<h2>Otsikko</h2><p>{long}</p><p>{SHORT}</p><p>{long}</p>{links}"
    assert main_text(page(body)).split("\n") == ["Otsikko", long, SHORT, long]


ARTICLE = f"<article><h1>Head</h1><p>{PROSE}</p></article>"


@pytest.mark.parametrize(
    "body",
    [
        f'<div class="layout no-sidebar">{ARTICLE}</div>',
        f'<div class="has-sticky-header">{ARTICLE}</div>',
        f'<div class="category-social-science">{ARTICLE}</div>',
        f'<article class="post comments-open"><h1>Head</h1><p>{PROSE}</p></article>',
        f'<form id="aspnetForm"><div class="header">{PROSE}</div>{ARTICLE}</form>',
        f'<div class="sidebarLayout widget">{ARTICLE}</div><div class="sidebar">{PROSE}</div>',
        f'<form id="main-form"><h1>Head</h1><p>{PROSE}</p></form><div class="ad">{SHORT}</div>',
        f'<div class="widget"><h1>Head</h1><p class="notice-of-award">{PROSE}</p></div>',
        f'<app-shell class="page-header"><main><h1>Head</h1><p>{PROSE}</p></main></app-shell>',
    ],
)
def test_a_class_does_not_empty_a_page(body):
    assert main_text(page(body)).split("\n") == ["Head", PROSE]


def test_hints_leave_out_what_is_beside_the_article():
    for name in ("sidebar", "ad-slot", "siteHeader", "main-nav", "cookie-banner", "related-posts", "newsletter_signup"):
        beside = f'<div class="{name}"><p>{PROSE}</p></div>'
        assert main_text(page(f"{beside}{ARTICLE}{beside}")).split("\n") == ["Head", PROSE]
        assert main_text(page(f"<p>{PROSE}</p><p>{PROSE}</p>{beside}")).split("\n") == [PROSE, PROSE]
    inside = f'<article><p>{PROSE} <span class="share">x</span></p><form><p>{PROSE}</p></form><p>{PROSE}</p></article>'
    assert main_text(page(inside)).split("\n") == [PROSE, PROSE]


LINKED = "<p><a href=x>One linked line of words</a></p>"
PLAIN = " ".join("tämä lause kertoo jotain muuta".split() * 8)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "{}"])
def test_neighbours_decide_inside_an_article_too(wrap):
    """A long block without stop words, and a short one, between link lists and between prose."""
    good = f"<p>{PROSE}</p>"
    for undecided in (PLAIN, SHORT):
        block = f"<p>{undecided}</p>"
        assert main_text(page(wrap.format(f"{good}{LINKED}{block}{LINKED}{good}"))).split("\n") == [PROSE, PROSE]
        assert main_text(page(wrap.format(f"{good}{block}{good}"))).split("\n") == [PROSE, undecided, PROSE]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "{}"])
def test_thresholds_change_results(wrap):
    near = "The house in the old town and on the hill was of another colour than it had been in other years, say many. " * 2
    body = page(wrap.format(f"{LINKED}<p>{PROSE}</p>{LINKED}<p>{near}</p>{LINKED}<p>{SHORT}</p><p>{PROSE}</p>"))
    usual = main_text(body)
    assert near.strip() in usual and SHORT in usual
    changed = [
        Rules(many_stop_words=1.1),
        Rules(many_stop_words=1.1, few_stop_words=1.1),
        Rules(long=10**9),
        Rules(links=1.0),
        Rules(short=10**9),
    ]
    # Without article and stop words the fallback may reach the same text.
    assert sum(main_text(body, rules) != usual for rules in changed) >= 3


def test_pages_without_article_tags(spark, sf):
    """Without the element the rules alone find nearly the same text."""
    texts = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    same = [main_text(t) == main_text(re.sub("</?article>", "", t)) for t in texts]
    assert len(same) > 20 and sum(same) >= 0.99 * len(same)


PIECES = ["<", ">", "/", "p", "a ", "<p>", "</p>", "<article>", "</article>", "'", '"', "&amp", ";", "<!--", "-->", "<script>", "div"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_any_markup_is_read(page):
    assert all(b.text for b in blocks(page))
    text = main_text(page)
    assert text == "\n".join(" ".join(line.split()) for line in text.split("\n"))


def test_hostile_pages_take_linear_time():
    for unit in ("<", "<p", "<a href='", "<div>", "</p>", "<!--", "&", '<p title="'):
        main_text(unit * 20000)


def test_rows(spark, hard):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"), (3, "v", "<article><p>" + "é" * 300000)]
    got = extract(spark.createDataFrame([(*r, "x") for r in rows * 2], "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (3, "v", "é" * 300000, 300000)] * 2, key=str
    )

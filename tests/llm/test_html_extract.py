import time

import pytest

from tidewater.llm import html_extract

SCHEMA = "page_id long, url string, html string"


def run(spark, pages):
    return {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}


@pytest.mark.parametrize("unit", ["<div>x ", "<div class='a b'><p>x ", "<b>x ", "<p><i>x ", "<ul><li>x ", "</div>x ", "<span><div>x </span>", "<a href='x>y ", "<table><tr><td>x "])
def test_time_grows_with_the_length_of_deep_pages(unit):
    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        html_extract.extract(unit * n, None)
        took.append(time.process_time() - start)
    assert took[0] < 1 and took[1] < 8 * took[0] + 0.3


def test_a_megabyte_of_unclosed_elements():
    start = time.process_time()
    text = html_extract.extract("<div>x " * 150_000, None)
    assert text.count("x") == 150_000 and time.process_time() - start < 10


@pytest.mark.parametrize("name", ["post social-science", "cookie-recipe", "rail-history", "reply-to-critics", "menu-of-the-restaurant-x", "footnotes"])
def test_words_among_others_in_a_class(name):
    page = f"<body><div class='story'><p>first words of it</p><div class='{name}'><p>and these belong to it too</p></div></div></body>"
    assert html_extract.extract(page, None) == "first words of it and these belong to it too"
    assert html_extract.extract(f"<div class='{name}'><p>all of the words</p></div>", None) == "all of the words"


@pytest.mark.parametrize("name", ["cookie-banner", "comment-list", "share_buttons", "related-posts", "adBox ad", "newsletter signup-form", "breadcrumb-list", "nav2"])
def test_names_of_what_is_no_article(name):
    assert html_extract.extract(f"<article><p>kept</p><div class='{name}'><p>other text of it</p></div></article>", None) == "kept"


def test_a_doubtful_name_with_links_only():
    page = "<div class='story'><p>words of the story</p><div class='menu-of-dishes'><a href=/a>one dish</a> <a href=/b>another dish</a></div></div>"
    assert html_extract.extract(page, None) == "words of the story"


def test_quotes_in_unquoted_values():
    assert html_extract.extract("<p title=don't>Hello, the first half isn't lost here.</p>", None) == "Hello, the first half isn't lost here."
    assert html_extract.extract("<article><p data-x = \"a>b\" y='>' z=\"it's\">one</p><p \">two</p></article>", None) == 'one two'


def test_unknown_elements_lie_in_their_line():
    assert html_extract.extract("<article><p>wo<my-tag>rd</my-tag>s <output>o</output>ne <ruby>k<rt>a</rt></ruby> sl<slot>ot</slot> <svg><text>no</text></svg>e<button>no</button>nd</p></article>", None) == "words one ka slot end"


def test_leads_and_codas_beside_the_story(spark):
    """Small containers in body: text that changes from page to page belongs to the story, what repeats does not."""
    body = " ".join(f"word{i}" for i in range(400))
    page = lambda i: f"<body><h1>The Paper</h1><div class='lead'><p>In short, {i}.</p></div><div class='text'><h2>Head {i}</h2><p>{body} {i}</p></div><div class='coda'>End of {i}</div><div class='info'>Printed daily.</div><div class='x'><a href=/1>more {i}</a></div></body>"
    got = run(spark, [(i, f"http://p.example/{i}", page(i)) for i in range(12)])
    assert got == {i: f"In short, {i}. Head {i} {body} {i} End of {i}" for i in range(12)}


def test_titles_beside_the_article(spark):
    """A site's name is the same on all pages, a title is not; one in a box of its own counts as well."""
    body = " ".join(f"word{i}" for i in range(60))
    page = lambda i: f"<body><div class='top'><h1>Site</h1></div><div class='wrap'><div class='entry-header'><h1>Title {i}</h1></div><div class='entry'><p>{body} {i}</p></div></div></body>"
    plain = lambda i: f"<body><h1>Site</h1><div class='wrap'><h1>Title {i}</h1><div class='entry'><p>{body} {i}</p></div></div></body>"
    got = run(spark, [(i, f"http://a.example/{i}", page(i)) for i in range(6)] + [(10 + i, f"http://b.example/{i}", plain(i)) for i in range(6)])
    assert got == {k: f"Title {k % 10} {body} {k % 10}" for k in [*range(6), *range(10, 16)]}


TEMPLATES = {
    "main": "<body><header><h1>S</h1></header><main id=m><h1>{t}</h1><p>{a}</p><figure><img src=x><figcaption>{c}</figcaption></figure><p>{b}</p></main><aside>{n}</aside><footer>{n}</footer></body>",
    "divs": "<body><div id=header><ul class=nav><li><a href=/>{n}</a></ul></div><div id=page><div class=content><h2>{t}</h2><p>{a}</p><blockquote>{c}</blockquote><p>{b}</p></div><div id=sidebar><p>{n}</p></div></div><div class=comments><p>{n} {n} {n}</p></div></body>",
    "table": "<body><table><tr><td class=menu><a href=/>{n}</a><td class=body><h3>{t}</h3><p>{a}<p>{c}<p>{b}</table></body>",
    "sections": "<body><nav>{n}</nav><article><header>{n}</header><h1>{t}</h1><section><p>{a}</p></section><section><ul><li>{c}</ul></section><section><p>{b}</p></section><footer>{n}</footer></article></body>",
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(spark, name):
    words = lambda k, n: " ".join(f"{k}{j}" for j in range(n))
    rows, want = [], {}
    for i in range(8):
        x = {"t": f"title {i}", "a": words(f"a{i}x", 40), "b": words(f"b{i}x", 60), "c": words(f"c{i}x", 8), "n": "same on all pages"}
        rows.append((i, f"http://{name}.example/{i}", TEMPLATES[name].format(**x)))
        want[i] = f"{x['t']} {x['a']} {x['c']} {x['b']}"
    assert run(spark, rows) == want

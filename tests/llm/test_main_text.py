import itertools
import random

import pytest

from catalograft.llm import main_text
from catalograft.llm.main_text import _PRIOR, blocks_of, content_of, min_cut


def text_of(page, weights=_PRIOR):
    blocks, content = content_of(page, weights)
    return "\n\n".join(b.text for b, c in zip(blocks, content, strict=True) if c)


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(abs(s) for s, c in zip(scores, side) if (s > 0) != c) + sum(w for (i, j), w in edges.items() if side[i] != side[j])

        assert cost(min_cut(scores, edges)) == pytest.approx(min(map(cost, itertools.product([True, False], repeat=n))))


def test_blocks_references_and_white_space():
    page = "<p>a&amp;b &lt;c&gt;\n\t d&nbsp;e</p>x<b>y</b>z<div>in<br>two</div><!-- <p>no</p> --><p>open<p>next<script>if(a<b){'</p>'}</script> end"
    assert [b.text for b in blocks_of(page)] == ["a&b <c> d e", "xyz", "in two", "open", "next end"]
    assert blocks_of("") == [] and blocks_of("<!-- open <p>x") == [] and blocks_of("<script>x") == []
    assert [b.text for b in blocks_of("just text < 3 &unknown; <")] == ["just text < 3 &unknown; <"]


PAGE = """<html><body class="post-page has-sidebar"><header><a href="/">Home</a><p>The tagline of the site.</p></header>
<div id="cookie-notice"><p>We use cookies to make this site better for you. Please accept them.</p><button>OK</button></div>
<div class="wrap"><%s><h1>A title &amp; more</h1><p>First <b>para</b>graph with some text, which is quite long and ends.</p>
<ul><li>one item</li><li>two item</li></ul><p>Short.</p><div class="advert"><p>Buy our product, the best product in the world.</p></div>
<p>Another paragraph, following the first one<br>with a break.</p></%s><aside><p>Sidebar text, rather long, that reads like prose.</p></aside>
<div id="comments"><p>I really liked this article, thanks for the writing of it.</p><form><label>Name</label><input></form></div></div>
<footer>copyright</footer></body></html>"""
WANTED = "A title & more\n\nFirst paragraph with some text, which is quite long and ends.\n\none item\n\ntwo item\n\nShort.\n\nAnother paragraph, following the first one with a break."


@pytest.mark.parametrize("tag, end", [("article", "article"), ('div class="main-content"', "div"), ("main", "main"), ("div", "div")])
def test_article_without_what_surrounds_it(spark, tag, end):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert text_of(PAGE % (tag, end)) == WANTED
    fitted = text_of(PAGE % (tag, end), main_text.fit(pages))
    if tag == "div":  # nothing but text says what its lists are; the sample's are all menus
        assert [p for p in WANTED.split("\n\n") if "item" not in p] == [p for p in fitted.split("\n\n") if "item" not in p]
    else:
        assert fitted == WANTED


def test_pages_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in main_text.extract(pages, main_text.fit(pages)).collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["main_text"] == "\n\n".join(p for p in parts if p)


def test_hard_rows(spark):
    rows = [(1, "u", None, 1), (2, "u", "", 1), (None, None, "<p>Some text of a page, long enough to be one.</p>", 1), (1, "u", None, 1), (3, "u", "<p>" * 3_000 + "x", 1), (4, "u", "<div>" * 2_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = main_text.extract(pages, main_text.fit(pages)).collect()
    assert len(got) == 6 and {r["main_text"] for r in got if not r["html"]} == {""}
    assert main_text.extract(pages.where("page_id = 0"), main_text.fit(pages.where("page_id = 0"))).count() == 0


@pytest.mark.parametrize("after", ["<body>", "<body><article>", "<article>", "<div>", "<p>", "<b>x</b> ", "text ", "<svg></svg>"])
def test_pages_that_leave_the_head_open(after):
    start = "<html><head><meta charset=utf-8><title>t</title><link rel=a><style>p{}</style><template><p>no</p></template>\n"
    wanted = [b.text for b in blocks_of(start + "</head>" + after + "The text.<p>More.")]
    assert [b.text for b in blocks_of(start + after + "The text.<p>More.")] == wanted
    assert " ".join(wanted).endswith("The text. More.") and "no" not in wanted


def test_page_without_head_end_keeps_its_article():
    page = PAGE.replace("<html>", "<html><head><title>t</title>") % ("article", "article")
    assert text_of(page) == WANTED


def test_formulas_stay_in_their_paragraph():
    page = "<p>Let <math><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>y</mi></mfrac></mrow></math> hold.</p>"
    assert [b.text for b in blocks_of(page)] == ["Let x=1y hold."]


LONG = "".join(f"<p>Paragraph {i} of the article tells at some length what happened, and then it ends.</p>" for i in range(5))
BESIDE = '<nav><a href="/">Home</a> <a href="/b">More</a></nav><div class="sidebar"><p>About the author of these pages, in short.</p><a href="/c">c</a></div>'


@pytest.mark.parametrize(
    "before, after",
    [
        ('<div class="elementor-widget">', "</div>"),
        ('<div class="container has-sidebar">', "</div>"),
        ('<article class="post tag-legal">', "</article>"),
        ('<form method="post" action="x.aspx"><article>', "</article></form>"),
        ('<form method="post" action="x.aspx"><div>', "</div></form>"),
        ('<div class="no-sidebar">', "</div>"),
        ('<div class="site-content sidebar-right"><main>', "</main></div>"),
        ('<div class="category-social">', "</div>"),
        ('<article class="category-reviews">', "</article>"),
        ('<div id="comments-and-text"><main>', "</main></div>"),
    ],
)
@pytest.mark.parametrize("fitted", [False, True])
def test_wrappers_keep_the_article(spark, before, after, fitted):
    weights = main_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")) if fitted else _PRIOR
    wanted = "\n\n".join(b.text for b in blocks_of(LONG))
    for page in (f"<body>{BESIDE}{before}{LONG}{after}</body>", f"<body>{before}{LONG}{after}{BESIDE}</body>"):
        assert text_of(page, weights) == wanted


def test_comments_and_notices_go_however_long():
    notice = '<div class="cookie-consent">' + "<p>We use cookies, and this tells at great length for what they are used.</p>" * 12 + "</div>"
    thread = '<div id="comments">' + '<article class="comment-body"><p>A reader says here what they think of all this, at length.</p></article>' * 12 + "</div>"
    wanted = "\n\n".join(b.text for b in blocks_of(LONG))
    assert text_of(f"<body>{notice}<div class=entry>{LONG}</div>{thread}</body>") == wanted
    assert text_of(f"<body>{notice}<article>{LONG}</article>{thread}</body>") == wanted


def test_deep_and_long_pages_take_linear_time():
    import time

    def seconds(page):
        begin = time.process_time()
        content_of(page, _PRIOR)
        return time.process_time() - begin

    for page in (lambda n: "<div>x " * n, lambda n: "<div>" * n + "<li>y</x>" * n, lambda n: "<p>Some words</p>" * n):
        seconds(page(500))
        assert seconds(page(16_000)) < 12 * max(seconds(page(4_000)), 0.05)

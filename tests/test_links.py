"""Links, headings and tokens, with a generator of pages as the oracle."""

import html as html_lib
import random
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from catalograft.functions import text, urls
from catalograft.operators import links

B = "https://shop.example"

CASES = {
    "l1": ('<a href="/p/a#x">1</a><a href="/p/a#y">2</a><a href="/p/b">3</a>', ["/p/a", "/p/b"]),
    "l2": (f'<a href="{B}/p/a">x</a>', []),
    "l5": ('<a href="/p/a&amp;b">x</a>', ["/p/a&b"]),
    "l6": ("<!-- <a href=\"/p/a\"> --><script>'<a href=\"/p/b\">'</script>", []),
    "unquoted": ("<A HREF=/p/u/>x</A>", ["/p/u/"]),
    "last_wins": ('<a href="/p/1" href="/p/2">x</a>', ["/p/2"]),
    "other_tag": ('<abbr href="/p/1">x</abbr><a data-href="/p/3" title=">" href=\'/p/4\'>x</a>', ["/p/4"]),
    "in_attribute": ("<div data-x='<a href=\"/p/1\">'><a href=\"/p/2\">x</a></div>", ["/p/2"]),
    "unfinished": ('<a href="/p/1">x</a><a href="/p/2"', ["/p/1"]),
    "empty": ("", []),
}


def test_collect_links(spark):
    pages = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "url string, html string")
    got = {k: [] for k in CASES}
    for r in links.collect_links(pages, ["/p/"]).orderBy("url", "pos").collect():
        got[r["url"]].append(r["href"])
    assert got == {k: v[1] for k, v in CASES.items()}


@pytest.mark.parametrize(
    "body, expected",
    [
        ('<a href="/p/1"><img></a><a href="/p/1">named</a>', [("/p/1", "")]),
        ('<a href="/p/1">never closed', []),
        ('<a href="/p/1">lost <a href="/p/2">x</a>', [("/p/2", "x")]),
        ('<a href="/p/1"> a <a href="/q">b</a> c</a>', [("/p/1", "a b")]),
        ('<a href="/p/1"/>t<a href="/p/2">a<!-- </a> -->b</a>', [("/p/1", ""), ("/p/2", "ab")]),
    ],
)
def test_named_links(spark, body, expected):
    pages = spark.createDataFrame([(1, body)], "page_id int, html string")
    rows = links.collect_named_links(pages, ["/p/"]).orderBy("pos").collect()
    assert [(r["href"], r["text"]) for r in rows] == expected


def test_generated_pages(spark):
    """Random closed anchors: what was written must come back, at any partitioning."""
    rng = random.Random(7)
    rows, expected = [], {}
    for page in range(200):
        parts, seen = [], {}
        for _ in range(rng.randint(0, 12)):
            href = rng.choice(["/p/", "/p/x/", "/q/"]) + rng.choice("abcd&é")
            label = rng.choice(["", " A ", "a < b", "é &", " x"])
            parts.append(f'<i>t</i><a class=c href="{html_lib.escape(href)}#f">{html_lib.escape(label)}</a>')
            if href.startswith("/p/"):
                seen.setdefault(href, label.strip())
        rows.append((page, "".join(parts)))
        expected[page] = list(seen.items())
    pages = spark.createDataFrame(rows, "page_id int, html string")
    for partitions in (1, 5):
        found = {page: [] for page, _ in rows}
        for r in links.collect_named_links(pages.repartition(partitions), ["/p/"]).orderBy("page_id", "pos").collect():
            found[r["page_id"]].append((r["href"], r["text"]))
        assert found == expected


@pytest.mark.parametrize(
    "hostile", ["<a ", "<!-- ", "<script>", '<a href="', "<h1>", "<a href='/p/x'>", "</a", "<", "< ", "<![cdata["]
)
def test_hostile_page_is_linear(spark, hostile):
    pages = spark.createDataFrame([(1, hostile * 50_000)], "page_id int, html string")
    started = time.time()
    assert links.collect_links(pages, ["/p/"]).count() <= 1
    links.h1_title(pages).collect()
    assert time.time() - started < 30


def test_unescape_matches_the_html_rules(spark):
    rng = random.Random(3)
    pieces = ["&amp;", "&lt", "&notit;", "&copy", "&#233;", "&#xe9", "&#x80;", "&#0;", "&#1114112;",
              "&#99999999999;", "&#xD800;", "&", "a b", "é", "&no;", "&nGtv;", "&#128512;", "&ampx",
              "=", ";", "&#x;", "&frac12x;", "&#xfffe;", "&#11;", "&nbsp;", "#"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.unescape(F.col("t")).alias("u"), text.strip_ws(F.col("t")).alias("s")).collect():
        assert r["u"] == html_lib.unescape(r["t"])
        assert r["s"] == r["t"].strip()


def test_url_functions(spark):
    refs = ["/x/y", "//host/x", "http://o/x", "", "mailto:a", "?q", "#f", "/a/../b", "/a/./b/", "/../x",
            "a//b", "/a/..", "x?y=//a/../b", "..", ".", "/a/b/../../c/./d", "/a:b", "/ingredients/x-1", "/é/b"]
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    for r in df.select("r", urls.root_join(F.col("r"), B).alias("j"), urls.build_url(F.col("r"), B).alias("b")).collect():
        assert r["j"] == urljoin(B + "/", r["r"].lstrip("/"))
        assert r["b"] == r["j"]
    names = spark.createDataFrame([("/brand/3ce-l'oreal/",)], "c string").select(
        urls.humanize_slug(F.col("c")),
        urls.humanize_slug(F.col("c"), "mention"),
        urls.query_join(F.lit(f"{B}/brands/x?page=2#t"), F.lit("?page=3")),
    ).first()
    assert tuple(names) == ("3Ce L'Oreal", "", f"{B}/brands/x?page=3")

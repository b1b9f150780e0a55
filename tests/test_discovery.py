"""Sitemaps, brand listings and the brand walk."""

import random

from catalograft.operators import directory, discovery, sitemaps
from catalograft.operators.brand_pages import brand_products, walked

B = "https://shop.example"
NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


def make_pages(spark, site):
    rows = [(i, B + u, h) for i, (u, h) in enumerate(site.items())]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def anchors(*hrefs):
    return "".join(f'<a href="{h}">{h[-1]}</a>' for h in hrefs)


def sitemap(kind, item, *locs):
    body = "".join(f"<{item}><loc>{loc}</loc></{item}>" for loc in locs)
    return f'<?xml version="1.0"?><{kind} xmlns="{NS}">{body}</{kind}>'


def names(df):
    return [r["url"].removeprefix(B + "/brand/") for r in df.orderBy("offset", "pos").collect()]


def test_directory_ends_after_short_page(spark):
    site = {
        "/brands?offset=0": anchors("/brand/a", "/brand/b", "/brand/c"),
        "/brands?offset=3": anchors("/brand/d", "/brand/e", "/brand/f"),
        "/brands?offset=6": anchors("/brand/g", "/brand/h"),
        "/brands?offset=9": anchors("/brand/never"),
        "/brands?offset=03": anchors("/brand/never2"),
    }
    assert names(directory.brand_directory(make_pages(spark, site), B)) == list("abcdefgh")


def test_directory_ends_before_missing_page(spark):
    site = {
        "/brands?offset=0": anchors("/brand/a", "/brand/b"),
        "/brands?offset=2": anchors("/brand/c", "/brand/d"),
        "/brands?offset=6": anchors("/brand/never", "/brand/never2"),
    }
    assert names(directory.brand_directory(make_pages(spark, site), B)) == list("abcd")
    del site["/brands?offset=0"]
    assert names(directory.brand_directory(make_pages(spark, site), B)) == []


def first_spots(site):
    """By the prefix rule: a page counts if the one before it does and it lists a brand no
    earlier page that counts lists. A brand belongs to the first page that counts."""
    counts = []
    for token_no, page in sorted(site):
        before = {b for spot in counts for b in site[spot]}
        if (page == 1 or (token_no, page - 1) in counts) and set(site[token_no, page]) - before:
            counts.append((token_no, page))
    brands = {b for spot in counts for b in site[spot]}
    return sorted((b, *min(spot for spot in counts if b in site[spot])) for b in brands)


def test_letters_match_sequential_reading(spark):
    rng = random.Random(11)
    for _ in range(4):
        site = {
            (t, p): [f"/brand/{rng.randint(0, 14)}" for _ in range(rng.randint(0, 4))]
            for t in rng.sample(range(1, 29), 6)
            for p in range(1, 5)
            if rng.random() < 0.85
        }
        pages = make_pages(
            spark,
            {
                f"/brands?letter={directory.LETTERS[t - 1]}" + (f"&page={p}" if p > 1 else ""): anchors(*hrefs)
                for (t, p), hrefs in site.items()
            },
        )
        got = directory.brand_letters(pages, B).collect()
        assert sorted((r["url"].removeprefix(B), r["token_no"], r["page"]) for r in got) == first_spots(site)


def by_distance(start, site):
    """Products in order of their page's shortest path of link positions, the least if several."""
    paths = {start: ()}
    while True:
        steps = [
            (start.split("?")[0] + ref, (*path, pos))
            for url, path in paths.items()
            for pos, ref in enumerate(site.get(url, ([], []))[1])
        ]
        best = {}
        for url, path in [*paths.items(), *steps]:
            best[url] = min(path, best.get(url, path), key=lambda p: (len(p), p))
        if best == paths:
            break
        paths = best
    mentions = [m for url in sorted(paths, key=lambda u: (len(paths[u]), paths[u])) for m in site.get(url, ([], []))[0]]
    first_names = dict(reversed(mentions))
    return [(href, first_names[href]) for href in dict.fromkeys(href for href, _ in mentions)]


def test_brand_walk_matches_queue_order(spark):
    rng = random.Random(5)
    site, starts = {}, [f"/brand/b{i}" for i in range(6)]
    for start in starts:
        for n in range(6):
            if n and rng.random() < 0.2:
                continue
            url = start + (f"?page={n}" if n else "")
            products = {f"/products/{rng.randint(0, 20)}": f"n{rng.randint(0, 99)}" for _ in range(3)}
            site[url] = (list(products.items()), [f"?page={rng.randint(0, 5)}" for _ in range(rng.randint(0, 3))])
    pages = make_pages(
        spark,
        {
            u: "".join(f'<a href="{h}">{t}</a>' for h, t in products)
            + "".join(f'<a href="{r}">p</a>' for r in refs)
            for u, (products, refs) in site.items()
        },
    )
    brands = spark.createDataFrame([(i, B + s) for i, s in enumerate(starts)], "brand_id bigint, url string")
    got = {i: [] for i in range(len(starts))}
    for r in brand_products(brands, pages, B, under=f"{B}/brand").orderBy("brand_id", "level", "rank", "pos").collect():
        got[r["brand_id"]].append((r["url"].removeprefix(B), r["name"]))
    assert got == {i: by_distance(s, site) for i, s in enumerate(starts)}


def sitemap_site():
    return {
        "/sitemap.xml": sitemap("sitemapindex", "sitemap", f"{B}/Product-1.xml", f"{B}/blog.xml", f"{B}/product-bad.xml", f"{B}/product-gone.xml", f"{B}/product-2.xml"),
        "/Product-1.xml": sitemap("urlset", "url", f"{B}/products/1", f"{B}/about", f"{B}/products/2"),
        "/product-2.xml": sitemap("urlset", "url", f"{B}/products/2", f"{B}/Products/x"),
        "/blog.xml": sitemap("urlset", "url", f"{B}/products/blog"),
        "/product-bad.xml": sitemap("urlset", "url", f"{B}/products/bad")[:-3],
    }


def test_sitemaps(spark):
    rows = sitemaps.sitemap_products(make_pages(spark, sitemap_site()), B).orderBy("child_pos", "pos").collect()
    assert [r["url"].removeprefix(B) for r in rows] == ["/products/1", "/products/2", "/products/2"]
    broken = dict(sitemap_site(), **{"/sitemap.xml": sitemap_site()["/sitemap.xml"] + "<x>"})
    assert sitemaps.sitemap_products(make_pages(spark, broken), B).count() == 0


def test_auto_keeps_the_sitemap_position(spark):
    site = {
        **sitemap_site(),
        "/brands?letter=a": anchors("/brand/x"),
        "/brand/x": anchors("/products/2", "/products/3"),
    }
    rows = discovery.discover_product_urls(make_pages(spark, site), B).orderBy("ord").collect()
    assert [(r["url"].removeprefix(B), r["source"]) for r in rows] == [
        ("/products/1", "sitemap"), ("/products/2", "sitemap"), ("/products/3", "brands")
    ]


FORMS = {
    "prefix": f'<sm:urlset xmlns:sm="{NS}"><sm:url><sm:loc> {B}/products/1 </sm:loc></sm:url></sm:urlset>',
    "doctype": f'<!DOCTYPE urlset><urlset xmlns="{NS}"><url><loc>{B}/products/1</loc></url></urlset>',
    "mark": f'\ufeff<?xml version="1.0"?><urlset xmlns="{NS}"><url><loc>{B}/products/1</loc></url></urlset>',
    "after": f'<urlset xmlns="{NS}"><url><loc>{B}/products/1</loc></url></urlset><?done yes?><!-- end -->',
    "deep": f'<urlset xmlns="{NS}"><a><b><url><loc>{B}/products/1</loc></url></b></a></urlset>',
    "reference": f'<urlset xmlns="{NS}"><url><loc>{B}/products/1?a=1&amp;b=2</loc></url></urlset>',
}
BAD = {
    "case": f'<urlset xmlns="{NS}"><url><LOC>{B}/products/1</LOC></url></urlset>',
    "text after": f'<urlset xmlns="{NS}"><url><loc>{B}/products/1</loc></url></urlset>x',
    "cut": f'<urlset xmlns="{NS}"><url><loc>{B}/products/1</loc></url>',
    "other namespace": f'<urlset xmlns="{NS}x"><url><loc>{B}/products/1</loc></url></urlset>',
}


def test_forms_of_sitemaps(spark):
    docs = spark.createDataFrame([*FORMS.items(), *BAD.items(), ("null", None)], "url string, html string")
    got = {r["url"]: r["locs"] for r in sitemaps.sitemap_locs(docs).collect()}
    assert {u for u, locs in got.items() if locs} == set(FORMS)
    assert got["prefix"] == [f"{B}/products/1"] and got["reference"] == [f"{B}/products/1?a=1&b=2"]


def test_numbers_of_listings_too_large(spark):
    rows = [
        (1, B + "/brands?letter=a", '<a href="/brand/x">X</a>'), (2, B + "/brands?letter=a&page=99999999999", '<a href="/brand/y">Y</a>'),
        (3, B + "/brands?offset=0", '<a href="/brand/x">X</a>'), (4, B + "/brands?offset=" + "1" * 40, '<a href="/brand/y">Y</a>'),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert [r["url"] for r in directory.brand_letters(pages, B).collect()] == [B + "/brand/x"]
    assert [r["url"] for r in directory.brand_directory(pages, B).collect()] == [B + "/brand/x"]


def test_walks_in_one_task_and_in_rounds_agree(spark):
    rng = random.Random(4)
    links = []
    for brand in range(6):
        at = [f"{B}/brand/b{brand}", *(f"{B}/brand/b{brand}?page={n}" for n in range(2, 9))]
        links += [(u, pos, rng.choice(at)) for u in at for pos in range(rng.randint(0, 4))]
    edges = spark.createDataFrame(links + links[:3], "url string, pos int, next_url string")
    brands = spark.createDataFrame([(i, f"{B}/brand/b{i}") for i in range(6)] + [(0, f"{B}/brand/b0"), (9, f"{B}/brand/none")], "brand_id bigint, url string")

    def order(df):
        rows = df.orderBy("brand_id", "level", "rank").collect()
        assert len(rows) == len({(r["brand_id"], r["url"]) for r in rows})
        return [(r["brand_id"], r["level"], r["url"]) for r in rows]

    near = order(walked(brands, edges))
    # no address, some addresses, every address with links is too large for a task
    for most in (0, 10, 14):
        assert order(walked(brands, edges, most_links=most)) == near
    assert near[-1] == (9, 0, f"{B}/brand/none")


def test_a_long_chain_of_pages_is_one_walk(spark):
    n = 2_000
    at = [f"{B}/brand/long"] + [f"{B}/brand/long?page={i}" for i in range(2, n + 1)]
    links = [(at[i], p, at[j]) for i in range(n) for p, j in enumerate((max(i - 1, 0), min(i + 1, n - 1)))]
    edges = spark.createDataFrame(links, "url string, pos int, next_url string")
    brands = spark.createDataFrame([(1, at[0])], "brand_id bigint, url string")
    found = walked(brands, edges).orderBy("level").collect()
    assert [(r["url"], r["level"], r["rank"]) for r in found] == [(u, i, 0) for i, u in enumerate(at)]

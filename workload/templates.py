"""Captured pages built from the test tables.

Every page is written from table rows by string functions, so what an extraction
must give back can be read from the tables directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = "https://shop.example"
BRANDS_PER_PAGE = 10
LETTER_BRANDS_PER_PAGE = 3
PRODUCTS_PER_PAGE = 20
PAGER_LINKS = 10
URLS_PER_SITEMAP = 500
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _escaped(c: Column) -> Column:
    return F.replace(c, F.lit("&"), F.lit("&amp;"))


def brand_href(brand: Column) -> Column:
    return _text("/brand/", F.lower(F.translate(brand, "#", "-")))


def product_href(key: Column) -> Column:
    return _text("/products/p-", key.cast("string"))


def product_name(part_name: Column, key: Column) -> Column:
    return _text(part_name, " & Co ", key.cast("string"))


def _anchors(suppliers: Column) -> Column:
    """Ingredient anchors: labelled or with text; every fifth is named again later."""

    def anchor(s: Column) -> Column:
        href = _text("/ingredients/s-", s["key"].cast("string"))
        return F.when(
            s["key"] % 3 == 0, _text('<a data-name="', s["name"], '" href="', href, '"></a>')
        ).otherwise(_text('<li><a href="', href, '"> <b>', s["name"], "</b> </a></li>"))

    def again(s: Column) -> Column:
        return _text(
            '<a href="/ingredients/S-', s["key"].cast("string"), '">Alt ', s["name"], "</a>"
        )

    fifth = F.filter(suppliers, lambda s: s["key"] % 5 == 0)
    return _text(
        F.array_join(F.transform(suppliers, anchor), ""),
        F.array_join(F.transform(fifth, again), "\n"),
    )


def _json_names(suppliers: Column) -> Column:
    """Names the JSON-LD repeats in lower case, and one of its own."""
    even = F.filter(suppliers, lambda s: s["key"] % 2 == 0)
    return F.concat(F.transform(even, lambda s: F.lower(s["name"])), F.array(F.lit("Base Oil")))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part, in four kinds by key: JSON-LD root, JSON-LD graph, Open
    Graph only, heading and anchors only."""
    # dealt by part once: neither the distinct pairs nor the rosters need another exchange
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rosters = (
        pairs.join(suppliers, pairs["l_suppkey"] == suppliers["s_suppkey"])
        .groupBy("l_partkey")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.col("l_suppkey").alias("key"), F.col("s_name").alias("name")))
            ).alias("suppliers")
        )
    )
    part = table(spark, sf_dir, "part")
    joined = part.join(rosters, part["p_partkey"] == rosters["l_partkey"], "left")
    key, brand = F.col("p_partkey"), F.col("p_brand")
    name = product_name(F.col("p_name"), key)
    size = F.col("p_size").cast("string")
    listed = F.coalesce(
        F.col("suppliers"), F.array().cast("array<struct<key:bigint,name:string>>")
    )
    root = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"),
            name.alias("name"),
            F.struct(F.lit("Brand").alias("@type"), brand.alias("name")).alias("brand"),
            F.col("p_type").alias("description"),
            F.array(_text("https://cdn.example/", key.cast("string")), F.lit("x")).alias("image"),
            F.struct(
                F.col("p_retailprice").cast("string").alias("ratingValue"),
                size.alias("ratingCount"),
            ).alias("aggregateRating"),
            F.array(F.col("p_type"), _text("Size ", size)).alias("category"),
            _json_names(listed).alias("hasIngredient"),
        )
    )
    inner = F.to_json(
        F.struct(
            F.lit("ProductGroup").alias("@type"),
            name.alias("name"),
            brand.alias("brand"),
            F.struct(
                F.col("p_retailprice").alias("ratingValue"), F.col("p_size").alias("ratingCount")
            ).alias("aggregateRating"),
            F.col("p_type").alias("category"),
            F.array_join(_json_names(listed), ", ").alias("ingredients"),
        )
    )
    graph = _text('{"@graph":[{"@type":"WebPage","name":"page"},', inner, "]}")
    script = '<script type="application/ld+json">'
    brand_link = _text('<a href="', brand_href(brand), '">')
    head = (
        F.when(key % 4 == 0, _text(script, root, "</script>"))
        .when(
            key % 4 == 1,
            _text(
                script,
                '{"@type":"BreadcrumbList"}</script>',
                script,
                graph,
                '</script><meta name="description" content=" ',
                F.col("p_type"),
                ' ">',
            ),
        )
        .when(
            key % 4 == 2,
            _text(
                '<meta property="og:title" content="old"><meta property="og:title" content="',
                _escaped(name),
                '"><meta property="og:description" content="',
                F.col("p_type"),
                '"><meta property="og:image" content="https://cdn.example/',
                key.cast("string"),
                '">',
                brand_link,
                "<img></a>",
            ),
        )
        .otherwise(
            _text(
                "<h1>first</h1><h1> ",
                _escaped(name),
                " </h1>",
                '<meta name="description" content="',
                F.col("p_type"),
                '">',
                '<meta name="twitter:image" content="https://cdn.example/',
                key.cast("string"),
                '">',
                brand_link,
                brand,
                "</a>",
            )
        )
    )
    html = _text("<!DOCTYPE html><html><body><!-- <h1>no</h1> -->", head, _anchors(listed), "</body></html>")
    pages = joined.select(
        key.alias("page_id"), _text(BASE, product_href(key)).alias("url"), html.alias("html")
    )
    # captured pages come in many files; keep the built ones on all cores
    return pages.repartition(spark.sparkContext.defaultParallelism, "page_id")


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct brands, numbered by name from 0."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.withColumn("n", F.row_number().over(Window.orderBy("p_brand")) - 1)


def _link_page(links: DataFrame, by: list[str], order: str) -> DataFrame:
    """One body per group: its links joined in order."""
    body = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("link").alias("l")))),
            lambda x: x["l"],
        ),
        "\n",
    )
    return links.groupBy(*by).agg(body.alias("body"))


def _page(url: Column, body: Column) -> list[Column]:
    return [
        (F.xxhash64(url).bitwiseAND(F.lit(2**62 - 1))).alias("page_id"),
        url.alias("url"),
        _text("<html><body><ul>", body, "</ul></body></html>").alias("html"),
    ]


def directory_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand listing by offset, plus an off-step page and one beyond the end."""
    brands = _brands(spark, sf_dir)
    step = BRANDS_PER_PAGE
    named = F.when(F.col("n") % 3 == 0, _text(" ", F.col("p_brand"), " ")).otherwise("<img>")
    links = brands.select(
        (F.floor(F.col("n") / step) * step).alias("offset"),
        "n",
        _text('<a href="', brand_href(F.col("p_brand")), '#top">', named, "</a>").alias("link"),
    )
    pages = _link_page(links, ["offset"], "n")
    beyond = brands.agg((F.ceil((F.max("n") + 1) / step) * step + step).alias("offset"))
    stray = F.lit('<a href="/brand/never">never</a>').alias("body")
    pages = pages.unionByName(beyond.select("offset", stray)).unionByName(
        beyond.select(F.lit(5).cast("bigint").alias("offset"), stray)
    )
    url = _text(BASE, "/brands?offset=", F.col("offset").cast("string"))
    return pages.select(*_page(url, F.col("body")))


def letter_of(n: Column) -> Column:
    return F.substr(F.lit("abcdef"), (n % 5 + 1).cast("int"), F.lit(1))


def letter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand listing by letter; every page repeats a known brand, letter z lists only
    that, and letter y has a second page but no first."""
    per = LETTER_BRANDS_PER_PAGE
    brands = _brands(spark, sf_dir)
    known = brands.where("n = 0").select(
        _text('<a href="', brand_href(F.col("p_brand")), '">again</a>').alias("body")
    )
    links = brands.select(
        letter_of(F.col("n")).alias("letter"),
        (F.floor(F.floor(F.col("n") / 5) / per) + 1).alias("page"),
        "n",
        _text('<a href="', brand_href(F.col("p_brand")), '">b</a>').alias("link"),
    )
    pages = _link_page(links, ["letter", "page"], "n").select(
        "letter", "page", _text(F.col("body"), '<a href="/brand/brand-1">again</a>').alias("body")
    )
    one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    only_known = known.select(F.lit("z").alias("letter"), one.alias("page"), "body")
    after_known = known.select(
        F.lit("z").alias("letter"), two.alias("page"), F.lit('<a href="/brand/unread">u</a>').alias("body")
    )
    no_first = known.select(
        F.lit("y").alias("letter"), two.alias("page"), F.lit('<a href="/brand/unread">u</a>').alias("body")
    )
    pages = pages.unionByName(only_known).unionByName(after_known).unionByName(no_first)
    number = F.when(F.col("page") > 1, _text("&page=", F.col("page").cast("string"))).otherwise("")
    url = _text(BASE, "/brands?letter=", F.col("letter"), number)
    return pages.select(*_page(url, F.col("body")))


def brand_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product listings per brand with a pager to the next pages and back to page 1."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    part = table(spark, sf_dir, "part").withColumn("place", place)
    key = F.col("p_partkey")
    links = part.select(
        "p_brand",
        (F.floor(F.col("place") / PRODUCTS_PER_PAGE) + 1).alias("page"),
        "place",
        _text(
            '<a href="',
            product_href(key),
            '">',
            F.when(key % 7 == 0, "").otherwise(_escaped(product_name(F.col("p_name"), key))),
            "</a>",
        ).alias("link"),
    )
    bodies = _link_page(links, ["p_brand", "page"], "place")
    last = part.groupBy("p_brand").agg(
        (F.floor((F.count("*") - 1) / PRODUCTS_PER_PAGE) + 1).alias("last")
    )
    pages = bodies.join(last, "p_brand")
    following = F.when(
        F.col("page") < F.col("last"),
        F.sequence(F.col("page") + 1, F.least(F.col("page") + PAGER_LINKS, F.col("last"))),
    ).otherwise(F.array().cast("array<bigint>"))
    pager = F.array_join(
        F.transform(
            F.concat(F.array(F.lit(1).cast("bigint")), following),
            lambda n: _text('<a href="?page=', n.cast("string"), '">', n.cast("string"), "</a>"),
        ),
        "",
    )
    number = F.when(F.col("page") > 1, _text("?page=", F.col("page").cast("string"))).otherwise("")
    url = _text(BASE, brand_href(F.col("p_brand")), number)
    return pages.select(*_page(url, _text(F.col("body"), pager)))


def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap index, product sitemaps (every fourth cut short), and a blog sitemap."""
    key = F.col("p_partkey")
    chunk = F.floor(key / URLS_PER_SITEMAP)
    entries = table(spark, sf_dir, "part").select(
        chunk.alias("chunk"),
        key.alias("o"),
        _text("<url><loc>", BASE, product_href(key), "</loc></url>").alias("link"),
    )
    open_tag = f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{NAMESPACE}">'
    children = _link_page(entries, ["chunk"], "o").select(
        _text(BASE, "/sitemap-Products-", F.col("chunk").cast("string"), ".xml").alias("url"),
        _text(
            open_tag,
            F.col("body"),
            F.when(F.col("chunk") % 4 == 1, "<url><loc>").otherwise("</urlset>\n"),
        ).alias("html"),
    )
    blog = children.limit(1).select(
        F.lit(f"{BASE}/sitemap-blog.xml").alias("url"),
        F.lit(
            f"{open_tag}<url><loc>{BASE}/products/blog</loc></url></urlset>"
        ).alias("html"),
    )
    chunks = entries.select("chunk").distinct().select(
        F.col("chunk").alias("o"),
        F.lit(0).alias("one"),
        _text(
            "<sitemap><loc>", BASE, "/sitemap-Products-", F.col("chunk").cast("string"), ".xml</loc></sitemap>"
        ).alias("link"),
    )
    index = _link_page(chunks, ["one"], "o").select(
        F.lit(f"{BASE}/sitemap.xml").alias("url"),
        _text(
            f'<sitemapindex xmlns="{NAMESPACE}"><sitemap><loc>{BASE}/sitemap-blog.xml</loc></sitemap>',
            F.col("body"),
            f"<sitemap><loc>{BASE}/sitemap-products-gone.xml</loc></sitemap></sitemapindex>",
        ).alias("html"),
    )
    docs = children.unionByName(blog).unionByName(index)
    return docs.select(F.xxhash64("url").bitwiseAND(F.lit(2**62 - 1)).alias("page_id"), "url", "html")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole site."""
    pages = product_pages(spark, sf_dir)
    for part in (directory_pages, letter_pages, brand_pages, sitemap_pages):
        pages = pages.unionByName(part(spark, sf_dir))
    return pages

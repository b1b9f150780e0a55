"""Registered queries. Each takes (spark, sf_dir) and returns flat scalar columns."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalograft.functions import urls
from catalograft.functions.markup import explode_tokens
from catalograft.operators import directory, discovery, fetchlog, links, merges, products, queues, sitemaps
from catalograft.operators.brand_pages import brand_products as walk_brand_pages
from catalograft.plans import jobs
from catalograft.session import checkpoint_dir
from catalograft.sources import storage_json as storage
from catalograft.sources.pages import decode_captures, lookup_pages, read_pages, stream_pages
from catalograft.sources.store import CatalogStore
from catalograft.streaming.ingest import ingest_stream
from workload import templates
from workload.templates import BASE, table

NOW = dt.datetime(2024, 6, 1, 12, 0, 0, 999)


def _str(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _pages(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet")


# ---- links, headings, metas, blocks -------------------------------------------------


def token_kinds(spark, sf_dir):
    tokens = explode_tokens(_pages(spark, sf_dir))
    return tokens.groupBy("page_id").agg(
        F.count("*").alias("tokens"),
        F.sum(F.length("data")).alias("chars"),
        F.count_if(F.col("kind") == "a").alias("anchors"),
        F.count_if(F.col("kind") == "p").alias("paragraphs"),
    )


def collect_links(spark, sf_dir):
    return links.collect_links(_pages(spark, sf_dir), ["/"]).select("page_id", "pos", "href")


def named_links(spark, sf_dir):
    return links.collect_named_links(_pages(spark, sf_dir), ["/"]).select(
        "page_id", "pos", "href", "text"
    )


def h1_title(spark, sf_dir):
    return links.h1_title(_pages(spark, sf_dir)).select("page_id", "title")


def meta_map(spark, sf_dir):
    found = links.meta_map(templates.product_pages(spark, sf_dir))
    keys = ("og:title", "og:description", "og:image", "description", "twitter:image")
    return found.select(
        "page_id",
        F.size("meta").alias("n"),
        *(F.col("meta")[k].alias(k.replace(":", "_")) for k in keys),
    )


def jsonld_blocks(spark, sf_dir):
    blocks = links.jsonld_blocks(templates.product_pages(spark, sf_dir))
    return blocks.select(
        "page_id",
        "pos",
        F.coalesce(
            F.get_json_object("block", "$.@type"), F.get_json_object("block", "$.@graph[1].@type")
        ).alias("type"),
        F.coalesce(
            F.get_json_object("block", "$.name"), F.get_json_object("block", "$.@graph[1].name")
        ).alias("name"),
    )


def page_titles(spark, sf_dir):
    """Extraction over the raw pages, which have headings and links only."""
    fields = ("name", "brand", "ingredients", "extract_error")
    found = products.extract_products(_pages(spark, sf_dir), BASE, fields=fields)
    return found.select(
        "page_id", "url", "name", "brand", F.size("ingredients").alias("ingredients"), "extract_error"
    )


def page_decode(spark, sf_dir):
    charset = F.when(F.col("page_id") % 3 == 0, "utf-16-be").when(F.col("page_id") % 3 == 1, "UTF-8")
    body = F.when(
        F.col("page_id") % 3 == 0, F.encode("html", "UTF-16BE")
    ).otherwise(F.encode("html", "UTF-8"))
    status = F.when(F.col("page_id") % 10 == 9, 404).otherwise(200)
    captures = _pages(spark, sf_dir).select(
        "page_id", "url", status.alias("status"), body.alias("body"), charset.alias("charset")
    )
    return decode_captures(captures).select("page_id", F.md5("html").alias("digest"))


def page_lookup(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    again = pages.where("page_id % 4 = 0").select(
        (F.col("page_id") + 10_000_000).alias("page_id"), "url", "html"
    )
    asked = pages.select("url").unionByName(
        pages.select(F.concat("url", F.lit("#missing")).alias("url"))
    )
    found = lookup_pages(asked, pages.unionByName(again))
    return found.select("url", "page_id", "found", F.length("html").alias("chars"))


# ---- address and text functions ------------------------------------------------------


def url_functions(spark, sf_dir):
    url = F.col("url")
    path = F.regexp_replace(url, "^https?://[^/]*", "")
    return _pages(spark, sf_dir).select(
        "page_id",
        urls.build_url(url, BASE).alias("absolute"),
        urls.root_join(F.concat(F.lit("//"), path), BASE).alias("joined"),
        urls.query_join(url, F.lit("?page=3")).alias("paged"),
        urls.strip_fragment(url).alias("bare"),
        urls.has_prefix(path, ("/en/", "/fr/")).alias("en_or_fr"),
        urls.mention_key(F.lit(""), F.concat(F.lit(" "), F.upper(url))).alias("key"),
        urls.letter_url(F.lit("0-9"), F.col("page_id") % 3, BASE).alias("letter"),
    )


def humanize_slug(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    slug = F.concat(
        F.lit("/brand/"),
        F.lower(F.regexp_replace(F.concat_ws("-", "p_brand", "p_name", "p_type"), "[# ]", "-")),
        F.when(F.col("p_partkey") % 2 == 0, "/").otherwise(""),
    )
    return part.select(
        "p_partkey",
        urls.humanize_slug(slug).alias("link"),
        urls.humanize_slug(slug, "brand").alias("brand"),
        urls.humanize_slug(slug, "mention").alias("mention"),
    )


# ---- products -------------------------------------------------------------------------


def _extracted(spark, sf_dir, *fields):
    return products.extract_products(templates.product_pages(spark, sf_dir), BASE, fields=fields)


def product_core(spark, sf_dir):
    fields = ("name", "brand", "description", "image_url", "json_ld", "extract_error")
    return _extracted(spark, sf_dir, *fields).select(
        "page_id",
        "url",
        "name",
        "brand",
        "description",
        "image_url",
        F.col("json_ld").isNotNull().alias("has_node"),
        "extract_error",
    )


def product_rating(spark, sf_dir):
    return _extracted(spark, sf_dir, "rating_value", "rating_count").select("page_id", "rating_value", "rating_count")


def product_categories(spark, sf_dir):
    return _extracted(spark, sf_dir, "categories").select(
        "page_id", F.size("categories").alias("n"), F.array_join("categories", "|").alias("categories")
    )


def ingredient_mentions(spark, sf_dir):
    pages = templates.product_pages(spark, sf_dir)
    return products.ingredient_mentions(pages, BASE).select("page_id", "key", "kind", "name", "url")


def ingredients_resolved(spark, sf_dir):
    rosters = _extracted(spark, sf_dir, "ingredients").select("page_id", F.explode_outer("ingredients").alias("i"))
    return rosters.where("i is not null").select("page_id", "i.position", "i.name", "i.url")


def brand_mentions(spark, sf_dir):
    pages = templates.product_pages(spark, sf_dir)
    return products.brand_mentions(pages, BASE).select("page_id", "url", "text")


# ---- discovery ------------------------------------------------------------------------


def sitemap_children(spark, sf_dir):
    index = templates.sitemap_pages(spark, sf_dir).where(F.col("url") == f"{BASE}/sitemap.xml")
    return sitemaps.sitemap_children(index).select("pos", "loc")


def sitemap_products(spark, sf_dir):
    return sitemaps.sitemap_products(templates.sitemap_pages(spark, sf_dir), BASE).select("pos", "url")


def letter_seeds(spark, sf_dir):
    """Which letter listings are captured."""
    seeds = directory.letter_seeds(spark, BASE)
    return lookup_pages(seeds, templates.letter_pages(spark, sf_dir)).select("token_no", "token", "found")


def brand_directory(spark, sf_dir):
    return directory.brand_directory(templates.directory_pages(spark, sf_dir), BASE)


def brand_letters(spark, sf_dir):
    return directory.brand_letters(templates.letter_pages(spark, sf_dir), BASE)


def brand_products(spark, sf_dir):
    brands = directory.brand_directory(templates.directory_pages(spark, sf_dir), BASE)
    found = walk_brand_pages(
        brands.select(F.col("url").alias("brand_id"), "url"),
        templates.brand_pages(spark, sf_dir),
        BASE,
        under=f"{BASE}/brand",
    )
    return found.select("brand_id", "level", "pos", "url", "name")


def discover_auto(spark, sf_dir):
    pages = templates.letter_pages(spark, sf_dir)
    for part in (templates.brand_pages, templates.sitemap_pages):
        pages = pages.unionByName(part(spark, sf_dir))
    return discovery.discover_product_urls(pages, BASE).select("url", "source")


# ---- merges and queues ------------------------------------------------------------------


def _old_brands(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(key % 3 != 0).select(
        (key + 1).alias("id"),
        F.when(key % 7 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.concat(F.lit("/b/"), key.cast("string")).alias("url"),
        _time("2024-01-01 00:00:00").alias("discovered_at"),
        F.when(key % 5 == 0, _time("2024-02-01 00:00:00")).alias("processed_at"),
    )


def _order_text():
    return (
        F.when(F.col("o_orderstatus") == "F", "")
        .when(F.col("o_orderstatus") == "P", F.lit(None))
        .otherwise(F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")))
    )


def merge_brands(spark, sf_dir):
    incoming = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.coalesce(_order_text(), F.lit("")).alias("name"),
        F.concat(F.lit("/b/"), F.col("o_custkey").cast("string")).alias("url"),
    )
    merged = merges.merge_brands(_old_brands(spark, sf_dir), incoming, NOW)
    return merged.select("id", "name", "url", _str("discovered_at"), _str("processed_at"), "action")


def merge_inserted(spark, sf_dir):
    incoming = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.lit("n").alias("name"),
        F.concat(F.lit("/b/"), F.col("o_custkey").cast("string")).alias("url"),
    )
    return merges.inserted_count(merges.merge_brands(_old_brands(spark, sf_dir), incoming, NOW))


def _old_products(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(key % 4 != 0).select(
        (key + 1).alias("id"),
        F.when(key % 2 == 0, 1000 + key % 25).alias("brand_id"),
        F.concat(F.lit("/p/"), key.cast("string")).alias("url"),
        F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, "").otherwise(F.col("c_name")).alias("name"),
        F.when(key % 2 == 0, F.col("c_mktsegment")).alias("brand_name"),
        F.lit("old").alias("description"),
        F.lit("old").alias("image_url"),
        F.col("c_acctbal").alias("rating_value"),
        key.alias("rating_count"),
        F.array(F.col("c_mktsegment")).alias("categories"),
        F.lit('{"old":1}').alias("json_ld"),
        _time("2024-01-01 00:00:00").alias("discovered_at"),
        F.when(key % 5 == 0, _time("2024-02-01 00:00:00")).alias("scraped_at"),
    )


_PRODUCT = (
    "id", "brand_id", "url", "name", "brand_name", "description", "image_url", "rating_value",
    "rating_count",
)


def merge_queued(spark, sf_dir):
    brands = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("name"),
    )
    incoming = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        (F.col("o_orderkey") % 25).alias("brand_id"),
        F.concat(F.lit("/p/"), F.col("o_custkey").cast("string")).alias("url"),
        _order_text().alias("name"),
    )
    merged = merges.merge_queued_products(_old_products(spark, sf_dir), incoming, brands, NOW)
    return merged.select(*_PRODUCT, _str("discovered_at"), _str("scraped_at"), "action")


def merge_products(spark, sf_dir):
    priority = F.col("o_orderpriority")
    extracted = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit("/p/"), F.col("o_custkey").cast("string")).alias("url"),
        _order_text().alias("name"),
        F.when(F.col("o_orderkey") % 3 == 0, priority).alias("brand"),
        F.when(F.col("o_orderkey") % 2 == 0, priority).alias("description"),
        F.lit(None).cast("string").alias("image_url"),
        F.col("o_totalprice").alias("rating_value"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("rating_count"),
        F.array(priority).alias("categories"),
        F.lit(None).cast("string").alias("json_ld"),
    )
    merged = merges.merge_products(_old_products(spark, sf_dir), extracted, NOW)
    return merged.select(
        *_PRODUCT,
        F.array_join("categories", "|").alias("categories"),
        "json_ld",
        _str("discovered_at"),
        _str("scraped_at"),
        "action",
    )


def _old_ingredients(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("product_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("int").alias("position"),
        F.concat(F.lit("/i/"), F.col("l_suppkey").cast("string")).alias("ingredient_url"),
        F.concat(F.lit("I "), F.col("l_partkey").cast("string")).alias("ingredient_name"),
        F.create_map().cast("map<string,string>").alias("extra"),
    )


def replace_ingredients(spark, sf_dir):
    extra = F.create_map().cast("map<string,string>")
    entries = F.transform(
        F.split("o_orderpriority", "-"),
        lambda part, i: F.struct(
            (i + 1).alias("position"), part.alias("name"), F.lit("").alias("url"), extra.alias("extra")
        ),
    )
    saved = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("product_id"),
        F.when(F.col("o_orderkey") % 2 == 0, entries).otherwise(F.slice(entries, 1, 0)).alias("ingredients"),
    )
    return merges.replace_ingredients(_old_ingredients(spark, sf_dir), saved).drop("extra")


def mark_processed(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        (F.col("o_custkey") + 1).alias("id")
    )
    marked = merges.mark_processed(_old_brands(spark, sf_dir), ids, NOW)
    return marked.select("id", "name", "url", _str("discovered_at"), _str("processed_at"))


def mark_scraped(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        (F.col("o_custkey") + 1).alias("id")
    )
    marked = merges.mark_scraped(_old_products(spark, sf_dir), ids, NOW)
    return marked.select("id", "url", _str("scraped_at"))


def pending_brands(spark, sf_dir):
    return queues.pending_brands(_old_brands(spark, sf_dir)).select("id", "name", "url")


def _queue_state(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("/p/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("discovered_at"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None))
        .otherwise(F.col("o_orderdate").cast("timestamp_ntz"))
        .alias("scraped_at"),
    )


def product_queue(spark, sf_dir):
    return queues.product_queue(_queue_state(spark, sf_dir)).select("id", "url", _str("discovered_at"))


def take_success(spark, sf_dir):
    extracted = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("discovered_at"),
        F.col("o_orderkey").alias("id"),
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", "failed").alias("extract_error"),
    )
    return queues.take_success(extracted, 100, "discovered_at", "id").select("id", "o_totalprice")


def skip_done(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/p/"), F.col("l_orderkey").cast("string")).alias("url")
    ).distinct()
    return queues.pending(asked, _queue_state(spark, sf_dir))


def read_products(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("/p/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderpriority").alias("name"),
        F.lit(None).cast("string").alias("brand_name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("image_url"),
        F.col("o_totalprice").alias("rating_value"),
        F.col("o_custkey").alias("rating_count"),
        F.lit(None).cast("array<string>").alias("categories"),
        F.lit(None).cast("string").alias("json_ld"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("scraped_at"),
    )
    found = queues.read_products(stored, _old_ingredients(spark, sf_dir))
    return found.select(
        "id",
        "name",
        "rating_value",
        F.size("categories").alias("categories"),
        F.size("ingredients").alias("n"),
        F.array_join(F.transform("ingredients", lambda i: i["name"]), "|").alias("ingredients"),
    )


def storage_json(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(
            F.col("p_size") % 5 != 0,
            F.array("p_type", F.concat(F.lit('Größe "😀" '), F.col("p_size").cast("string"))),
        ).alias("categories"),
        F.when(F.col("p_size") % 2 == 0, F.lit("{}"))
        .otherwise(F.to_json(F.struct("p_name")))
        .alias("json_ld"),
    )
    stored = storage.to_storage_json(part)
    back = storage.from_storage_json(stored).select(
        "p_partkey", F.size("categories").alias("n"), F.array_join("categories", "|").alias("read_back")
    )
    return stored.join(back, "p_partkey")


# ---- jobs ---------------------------------------------------------------------------------


def _workspace(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/workspace-{uuid.uuid4().hex}"


def _stored(store: CatalogStore) -> DataFrame:
    found = queues.read_products(store.read("products"), store.read("product_ingredients"))
    ingredients = F.col("ingredients")
    return found.select(
        "url",
        "name",
        "brand",
        "description",
        "rating_value",
        F.size("categories").alias("categories"),
        F.size(ingredients).alias("n"),
        F.try_element_at(ingredients, F.lit(1))["name"].alias("first_ingredient"),
        F.try_element_at(ingredients, F.lit(-1))["name"].alias("last_ingredient"),
    )


def _saved_site(spark, sf_dir, workspace, site=templates.site_pages):
    site(spark, sf_dir).write.parquet(f"{workspace}/pages")
    return read_pages(spark, f"{workspace}/pages")


def brand_catalogue(spark, sf_dir):
    workspace = _workspace(spark)
    pages = _saved_site(spark, sf_dir, workspace)
    store = CatalogStore(spark, f"{workspace}/store")
    jobs.run(store, pages, BASE, NOW, strategy="brands")
    brand = store.read("products").select("url", F.col("brand_id").isNotNull().alias("queued"))
    return _stored(store).join(brand, "url")


def sitemap_catalogue(spark, sf_dir):
    workspace = _workspace(spark)
    pages = _saved_site(spark, sf_dir, workspace)
    store = CatalogStore(spark, f"{workspace}/store")
    jobs.run(store, pages, BASE, NOW, strategy="sitemap")
    return _stored(store)


def stream_ingest(spark, sf_dir):
    workspace = _workspace(spark)
    _saved_site(spark, sf_dir, workspace, templates.product_pages)
    store = CatalogStore(spark, f"{workspace}/store")
    pages = stream_pages(spark, f"{workspace}/pages")
    ingest_stream(pages, store, BASE, f"{workspace}/progress", lambda: NOW).awaitTermination()
    return _stored(store)


# ---- fetch log -------------------------------------------------------------------------------


def _fetch_log(spark, sf_dir):
    kind, n = F.col("event_type"), F.col("event_id")
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        F.concat(host, F.lit("/"), (n % 50).cast("string")).alias("url"),
        host.alias("host"),
        (n % 5 + 1).cast("int").alias("attempt"),
        F.when(kind == "error", 503)
        .when(kind == "signup", 404)
        .when(kind == "purchase", 204)
        .when(kind == "click", 200)
        .cast("int")
        .alias("status"),
        F.col("ts"),
        n.alias("event_id"),
    )


def fetch_triage(spark, sf_dir):
    return fetchlog.triage_fetch_log(_fetch_log(spark, sf_dir))


def politeness_gaps(spark, sf_dir):
    gaps = fetchlog.politeness_gaps(_fetch_log(spark, sf_dir), throttle=3600.0, key="event_id")
    return gaps.select("host", "event_id", F.round("gap_seconds", 6).alias("gap_seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        token_kinds, collect_links, named_links, h1_title, meta_map, jsonld_blocks, page_titles,
        page_decode, page_lookup, url_functions, humanize_slug, product_core, product_rating,
        product_categories, ingredient_mentions, ingredients_resolved, brand_mentions,
        sitemap_children, sitemap_products, letter_seeds, brand_directory, brand_letters,
        brand_products, discover_auto, merge_brands, merge_inserted, merge_queued, merge_products,
        replace_ingredients, mark_processed, mark_scraped, pending_brands, product_queue,
        take_success, skip_done, read_products, storage_json, brand_catalogue, sitemap_catalogue,
        stream_ingest, fetch_triage, politeness_gaps,
    )
}

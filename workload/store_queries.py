"""Queries of the bucketed store: captures, rosters, commits, streams that arrive out of order, top lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalograft.operators import analytics, merges, queues
from catalograft.sources.captures import add_captures, captured_pages
from catalograft.sources.commitlog import AlreadyCommitted
from catalograft.sources.pages import lookup_pages, stream_pages
from catalograft.sources.store import CatalogStore
from catalograft.streaming.ingest import ingest_stream
from workload import templates
from workload.oracles import ORACLES
from workload.queries import NOW, _old_ingredients, _pages, _stored, _workspace
from workload.templates import BASE, table


def _store(spark) -> CatalogStore:
    return CatalogStore(spark, f"{_workspace(spark)}/store")


def capture_lookup(spark, sf_dir):
    """`page_lookup` on a capture store filled in three batches, the newest captures first."""
    pages = _pages(spark, sf_dir).select("page_id", "url", "html")
    again = pages.where("page_id % 4 = 0").withColumn("page_id", F.col("page_id") + 10_000_000)
    store = _store(spark)
    for batch in (again, pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")):
        add_captures(store, batch, most_segments=2)
    asked = pages.select("url").unionByName(pages.select(F.concat("url", F.lit("#missing")).alias("url")))
    found = lookup_pages(asked, captured_pages(store))
    return found.select("url", "page_id", "found", F.length("html").alias("chars"))


def roster_read(spark, sf_dir):
    """`read_products` on rosters clustered by product."""
    orders = table(spark, sf_dir, "orders")
    products = orders.select(
        F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("brand_id"),
        F.concat(F.lit("/p/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("name"),
        *(F.lit(None).cast(k).alias(c) for c, k in (("brand_name", "string"), ("description", "string"), ("image_url", "string"))),
        F.col("o_totalprice").alias("rating_value"), F.col("o_custkey").alias("rating_count"),
        F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("string").alias("json_ld"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("discovered_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp_ntz")).alias("scraped_at"),
    )
    store = _store(spark)
    version = store.begin()
    version.write("products", products)
    version.write("product_ingredients", _old_ingredients(spark, sf_dir))
    version.commit()
    found = queues.read_products(store.read("products"), store.clustered("product_ingredients"))
    return found.select(
        "id", "name", "rating_value", F.size("categories").alias("categories"), F.size("ingredients").alias("n"),
        F.array_join(F.transform("ingredients", lambda i: i["name"]), "|").alias("ingredients"),
    )


def commit_log(spark, sf_dir):
    """Three versions of the brands, a second writer that is refused, and the versions a clean-up keeps."""
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.concat(F.lit("/b/"), F.col("c_custkey").cast("string")).alias("url")
    )
    store = _store(spark)
    batches = [people.where("ord % 2 = 0"), people, people.where("ord % 5 = 0").withColumn("name", F.lit("renamed"))]
    refused = 0
    for batch in batches:
        version, rival = store.begin(), store.begin()
        for writer, rows in ((version, batch), (rival, people.withColumn("name", F.lit("rival")))):
            touched = writer.touched("brands", rows)
            merged = merges.merge_brands(writer.read("brands", touched), rows, NOW, writer.last_id("brands"))
            writer.write("brands", merged, touched)
        version.commit()
        try:
            rival.commit()
        except AlreadyCommitted:
            refused += 1
    store.vacuum(keep=2, grace_seconds=0)
    out = None
    for number in store.log.versions():
        brands = store.read("brands", number)
        counted = brands.agg(
            F.count("*").alias("brands"), F.countDistinct("id").alias("ids"), F.max("id").alias("last_id"),
            F.count_if(F.col("name") == "renamed").alias("renamed"), F.count_if(F.col("name") == "rival").alias("rivals"),
        )
        counted = counted.select(F.lit(number).cast("long").alias("version"), "*", F.lit(refused).cast("long").alias("refused"))
        out = counted if out is None else out.unionByName(counted)
    return out


def stream_newest(spark, sf_dir):
    """A stream that gets the newest captures first, then older ones of the same addresses."""
    store = _store(spark)
    site = templates.product_pages(spark, sf_dir)
    older = site.withColumn("html", F.lit("<h1>older</h1>"))
    newer = site.withColumn("page_id", F.col("page_id") + 1_000_000_000)
    for i, batch in enumerate((newer, older)):
        batch.write.mode("append").parquet(f"{store.root}-pages")
        pages = stream_pages(spark, f"{store.root}-pages")
        ingest_stream(pages, store, BASE, f"{store.root}-progress", lambda day=i: NOW + dt.timedelta(days=day)).awaitTermination()
    return _stored(store)


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("product_id"),
        F.col("l_linenumber").alias("position"),
        F.when(F.col("l_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit("Part "), F.col("l_partkey") % 500)).alias("ingredient_name"),
    )


def top_ingredients(spark, sf_dir):
    return analytics.top_ingredients(_entries(spark, sf_dir), 25)


def brand_ingredients(spark, sf_dir):
    products = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")).alias("brand_name")
    )
    return analytics.brand_ingredients(products, _entries(spark, sf_dir))


STORE_QUERIES = {
    f.__name__: f
    for f in (capture_lookup, roster_read, commit_log, stream_newest, top_ingredients, brand_ingredients)
}

_NAMED = "SELECT l_orderkey AS id, l_linenumber AS position, 'part ' || l_partkey % 500 AS ingredient FROM lineitem WHERE l_partkey % 9 <> 0"

STORE_ORACLES = {
    "capture_lookup": ORACLES["page_lookup"],
    "roster_read": ORACLES["read_products"],
    "commit_log": """
SELECT 2 AS version, count(*) AS brands, count(*) AS ids, count(*) AS last_id, 0 AS renamed, 0 AS rivals, 3 AS refused FROM customer
UNION ALL SELECT 3, count(*), count(*), count(*), count(*) FILTER (c_custkey % 5 = 0), 0, 3 FROM customer""",
    "stream_newest": ORACLES["stream_ingest"],
    "top_ingredients": f"""
WITH named AS ({_NAMED})
SELECT ingredient, count(DISTINCT id) AS products, min(position)::BIGINT AS best_position
FROM named GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
    "brand_ingredients": f"""
WITH named AS ({_NAMED})
SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS brand, count(DISTINCT o_orderkey) AS products,
  count(DISTINCT ingredient) AS ingredients, count(DISTINCT (o_orderkey, ingredient)) FILTER (ingredient IS NOT NULL) AS mentions
FROM orders LEFT JOIN named ON o_orderkey = id GROUP BY 1""",
}

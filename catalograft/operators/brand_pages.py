"""Products of brands: a breadth-first walk over the page links of all brands at once."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalograft.functions.stages import exploded
from catalograft.functions.text import blank_to_null
from catalograft.functions.urls import before_query, build_url, humanize_slug, query_join
from catalograft.functions.markup import with_marks
from catalograft.operators.links import links_in, named_links_in
from catalograft.session import checkpoint_dir, settle
from catalograft.sources.pages import current

PRODUCT_PREFIX = "/products/"
PAGER_PREFIX = "?page="
#: Page links of one address, before the query, that a task may hold.
MOST_LINKS = 200_000


def walked(brands: DataFrame, edges: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """Pages reached from each brand, as (brand_id, url, level, rank), by links (url, pos, next_url).

    A page link changes the query alone, so a walk never leaves its address before the query.
    The links of such an address, ids and addresses without bodies, are walked in one
    task, however long the chain, if there are at most `most_links`; the few addresses with more
    advance together in rounds over shared tables, one per level. Both give the same order.
    """
    starts = settle(brands.select("brand_id", "url").distinct().withColumn("path", before_query(F.col("url"))))
    paths = edges.withColumn("path", before_query(F.col("url")))
    # narrow counts; a task's group is bounded by them
    large = settle(paths.groupBy("path").count().where(F.col("count") > most_links).select("path"))
    few = starts.join(large, "path", "left_anti")
    short = few.groupBy("path").cogroup(paths.join(large, "path", "left_anti").groupBy("path"))
    kind = starts.select("brand_id", "url", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("rank")).schema
    near = short.applyInArrow(_walk, kind)
    if large.isEmpty():
        return near
    far = _walked_in_rounds(starts.join(large, "path", "left_semi"), paths.join(large, "path", "left_semi"))
    return near.unionByName(far)


def _walk(starts: pa.Table, links: pa.Table) -> pa.Table:
    """First in, first out from each brand's address."""
    after: dict[str, list[tuple[int, str]]] = {}
    for url, pos, following in zip(*(links.column(c).to_pylist() for c in ("url", "pos", "next_url")), strict=True):
        after.setdefault(url, []).append((pos, following))
    for found in after.values():
        found.sort(key=lambda link: link[0])
    by_brand: dict[object, list[str]] = {}
    for brand, url in zip(starts.column("brand_id").to_pylist(), starts.column("url").to_pylist(), strict=True):
        by_brand.setdefault(brand, []).append(url)
    out: list[tuple[object, str, int, int]] = []
    for brand, frontier in by_brand.items():
        seen, level = set(frontier), 0
        out += [(brand, url, 0, 0) for url in frontier]
        while frontier:
            level, reached = level + 1, []
            for url in frontier:
                for _, following in after.get(url, ()):
                    if following is not None and following not in seen:
                        seen.add(following)
                        reached.append(following)
            out += [(brand, url, level, rank) for rank, url in enumerate(reached)]
            frontier = reached
    kinds = (("brand_id", starts.schema.field("brand_id").type), ("url", pa.string()), ("level", pa.int32()), ("rank", pa.int64()))
    columns = zip(*out, strict=True) if out else ((),) * 4
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)})


def _walked_in_rounds(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """All walks advance together; what they visited is one folder, so the plan of a round stays as it is."""
    spark = starts.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/walk-{uuid.uuid4().hex}"
    first = starts.select("brand_id", "url", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("rank"))
    kind = first.schema
    first.write.parquet(f"{folder}/0")
    level = 0
    while True:
        frontier = spark.read.schema(kind).parquet(f"{folder}/{level}")
        if frontier.isEmpty():
            break
        seen = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(folder).select("brand_id", "url")
        reached = (
            frontier.join(edges, "url")
            .groupBy("brand_id", F.col("next_url").alias("url"))
            .agg(F.min(F.struct("rank", "pos")).alias("via"))
            .join(seen, ["brand_id", "url"], "left_anti")
        )
        level += 1
        # after a global sort the generated ids follow the sort order
        ranked = reached.orderBy("via").select(
            "brand_id", "url", F.lit(level).alias("level"), F.monotonically_increasing_id().alias("rank")
        )
        ranked.write.parquet(f"{folder}/{level}")
    return spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(folder)


def brand_products(
    brands: DataFrame, pages: DataFrame, base: str, under: str | None = None, most_links: int = MOST_LINKS
) -> DataFrame:
    """Products per brand, as (brand_id, level, rank, pos, url, name).

    `brands` is (brand_id, url). `under` is an address prefix all brand pages share;
    it keeps other pages out of the scan. (level, rank, pos) is the order in which a
    reader following the page links first in, first out meets the products. A product
    occurs once per brand, with the name of its first mention.

    `walked` follows the page links; `most_links` bounds what a task holds of them.
    """
    if under:
        pages = pages.where(F.col("url").startswith(under))
    marked = with_marks(current(pages).select("page_id", "url", "html"), ("a",))
    linked = named_links_in(marked, (PRODUCT_PREFIX,), "products").withColumn(
        "pagers", links_in(F.col("marks"), (PAGER_PREFIX,))
    )
    content = settle(linked.select("url", "products", "pagers"))
    edges = exploded(content, ["url"], F.col("pagers"), "ref").select(
        "url", "pos", query_join(F.col("url"), F.col("ref")).alias("next_url")
    )
    visited = walked(brands, settle(edges), most_links)
    mentions = exploded(
        visited.join(content, "url"),
        ["brand_id", "level", "rank"],
        F.col("products"),
        "product",
    )
    href = F.col("product.href")
    named = mentions.select(
        "brand_id",
        build_url(href, base).alias("url"),
        F.struct(
            "level",
            "rank",
            "pos",
            F.coalesce(blank_to_null(F.col("product.text")), humanize_slug(href)).alias("name"),
        ).alias("mention"),
    )
    first = named.groupBy("brand_id", "url").agg(F.min("mention").alias("mention"))
    return first.select(
        "brand_id", "mention.level", "mention.rank", "mention.pos", "url", "mention.name"
    )

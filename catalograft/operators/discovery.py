"""Product addresses over all discovery strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalograft.functions.urls import site_root
from catalograft.operators.brand_pages import brand_products
from catalograft.operators.directory import brand_letters
from catalograft.operators.sitemaps import sitemap_products

_STEPS = [f"k{i}" for i in range(1, 7)]


def _ordered(df: DataFrame, source: str, rank: int, *keys: str) -> DataFrame:
    zeros = [F.lit(0).cast("bigint")] * (len(_STEPS) - len(keys))
    steps = [F.col(k).cast("bigint") for k in keys] + zeros
    return df.select(
        "url",
        F.struct(
            F.lit(rank).alias("source_no"),
            *(c.alias(name) for c, name in zip(steps, _STEPS)),
            F.lit(source).alias("source"),
        ).alias("ord"),
    )


def from_brand_listings(pages: DataFrame, base: str) -> DataFrame:
    """Products of all brands of the letter listings, with their reading order."""
    listed = brand_letters(pages, base).withColumnRenamed("pos", "brand_pos")
    brands = listed.select(F.col("url").alias("brand_id"), "url")
    found = brand_products(brands, pages, base, under=site_root(base) + "/brand")
    return found.join(
        listed.select(F.col("url").alias("brand_id"), "token_no", "page", "brand_pos"), "brand_id"
    )


def discover_product_urls(pages: DataFrame, base: str, strategy: str = "auto") -> DataFrame:
    """Distinct product addresses, as (url, source, ord); the first strategy wins.

    `ord` is a struct that sorts in discovery order. Strategies are `sitemap`,
    `brands`, and `auto` for both in that order.
    """
    parts = []
    if strategy in ("auto", "sitemap"):
        parts.append(
            _ordered(sitemap_products(pages, base), "sitemap", 0, "child_pos", "pos")
        )
    if strategy in ("auto", "brands"):
        found = from_brand_listings(pages, base)
        parts.append(
            _ordered(
                found, "brands", 1, "token_no", "page", "brand_pos", "level", "rank", "pos"
            )
        )
    if not parts:
        raise ValueError(f"unknown strategy: {strategy}")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = every.groupBy("url").agg(F.min("ord").alias("ord"))
    return first.select("url", F.col("ord.source").alias("source"), "ord")

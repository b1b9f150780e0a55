"""Brand addresses from the paged brand directory, by offset and by letter."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalograft.functions.stages import exploded
from catalograft.functions.text import blank_to_null
from catalograft.functions.urls import build_url, humanize_slug, letter_url, site_root
from catalograft.operators.links import link_arrays, named_link_arrays
from catalograft.session import settle
from catalograft.sources.pages import current

# The letter tokens in reading order.
LETTERS = (*string.ascii_lowercase, "0-9", "other")


def letter_seeds(spark: SparkSession, base: str) -> DataFrame:
    """The first page of every letter, as (token_no, token, url); numbers start at 1."""
    tokens = F.posexplode(F.array(*map(F.lit, LETTERS))).alias("pos", "token")
    return spark.range(1).select(tokens).select(
        (F.col("pos") + 1).alias("token_no"),
        "token",
        letter_url(F.col("token"), F.lit(1), base).alias("url"),
    )


def brand_directory(pages: DataFrame, base: str) -> DataFrame:
    """Brands of the offset listing, as (offset, pos, name, url) in reading order.

    The number of links on the page at offset 0 is the step. Reading stops before
    the first missing or empty page and after the first page shorter than a step.
    """
    listing = site_root(base) + "/brands?offset="
    number = F.substr("url", F.lit(len(listing) + 1))
    # a number no page list can reach is not a page of it
    offset = F.when(number.rlike("^(?:0|[1-9][0-9]*)$"), number.try_cast("bigint"))
    candidates = pages.where(F.col("url").startswith(listing) & offset.isNotNull())
    links = named_link_arrays(current(candidates), ("/brand/",))
    read = settle(
        links.select(offset.alias("offset"), "links", F.size("links").alias("n"))
        .where(F.col("n") > 0)
    )
    first = read.where(F.col("offset") == 0).select("n").first()
    step = first["n"] if first else 1
    steps = read.where(F.col("offset") % step == 0)
    # the page after each page that is itself missing or empty
    gaps = steps.select((F.col("offset") + step).alias("offset")).join(
        steps.select("offset"), "offset", "left_anti"
    )
    bounds = gaps.agg(F.min("offset").alias("missing")).first()
    short = steps.where(F.col("n") < step).agg(F.min("offset").alias("offset")).first()
    missing = bounds["missing"] if first else 0
    kept = steps.where(F.col("offset") < F.lit(missing))
    if short["offset"] is not None:
        kept = kept.where(F.col("offset") <= short["offset"])
    link = exploded(kept, ["offset"], F.col("links"), "link")
    href = F.col("link.href")
    return link.select(
        "offset",
        "pos",
        F.coalesce(blank_to_null(F.col("link.text")), humanize_slug(href)).alias("name"),
        build_url(href, base).alias("url"),
    )


def brand_letters(pages: DataFrame, base: str) -> DataFrame:
    """Brands of the letter listings, as (token_no, page, pos, url), distinct by url.

    Letters are read in order, each page by page. A letter ends at a missing page or
    at a page whose brands all occurred before. Whether a page is read depends on
    the earlier letters, so every round judges all pages again with the previous
    round's result; letter j is settled after j rounds.
    """
    root = site_root(base)
    token = F.regexp_extract("url", r"\?letter=([^&]*)", 1)
    number = blank_to_null(F.regexp_extract("url", "&page=([0-9]+)", 1))
    # too large a number stays null, which is no page a reader asks for
    page = F.when(number.isNull(), 1).otherwise(number.try_cast("int"))
    token_no = F.array_position(F.array(*map(F.lit, LETTERS)), token).cast("int")
    candidates = pages.where(F.col("url").startswith(root + "/brands?letter="))
    links = link_arrays(current(candidates), ("/brands/", "/brand/"))
    listed = links.select("url", token_no.alias("token_no"), token.alias("token"), page.alias("page"), "links")
    # only addresses in the exact form a reader would ask for
    asked = listed.where(
        (F.col("token_no") > 0) & (F.col("url") == letter_url(F.col("token"), F.col("page"), base))
    )
    spots = exploded(asked, ["token_no", "page"], F.col("links"), "href").select(
        build_url(F.col("href"), base).alias("url"), "token_no", "page", "pos"
    )
    # at most one spot per letter and brand matters: its first page there
    first_spots = spots.groupBy("url", "token_no").agg(
        F.min(F.struct("page", "pos")).alias("spot")
    )
    brands = settle(
        first_spots.groupBy("url").agg(
            F.collect_list(F.struct("token_no", "spot.page", "spot.pos")).alias("spots")
        )
    )
    pages_read = {no: None for no in range(1, len(LETTERS) + 1)}
    for _ in range(len(LETTERS) + 1):
        judged = _productive_prefixes(brands, pages_read)
        if judged == pages_read:
            break
        pages_read = judged
    read = F.filter("spots", lambda s: _is_read(s, pages_read))
    first = F.array_min(read)
    return brands.where(F.size(read) > 0).select(
        first["token_no"].alias("token_no"),
        first["page"].alias("page"),
        first["pos"].alias("pos"),
        "url",
    )


def _is_read(spot, pages_read: dict):
    """True if the spot's page is among the pages read of its letter (None: all)."""
    limits = F.array(
        *(F.lit(2**31 - 1 if n is None else n).cast("int") for n in pages_read.values())
    )
    return spot["page"] <= F.element_at(limits, spot["token_no"])


def _productive_prefixes(brands: DataFrame, pages_read: dict) -> dict:
    """Per letter, the length of its unbroken run of pages that bring a new brand.

    The result has one number per letter, so it may come to the driver.
    """
    earliest = F.array_min(
        F.transform(
            F.filter("spots", lambda s: _is_read(s, pages_read)), lambda s: s["token_no"]
        )
    )
    new_at = F.filter(
        "spots", lambda s: s["token_no"] <= F.coalesce(earliest, s["token_no"])
    )
    productive = (
        exploded(brands, [], new_at, "spot").select("spot.token_no", "spot.page").distinct()
    )
    starts = brands.sparkSession.range(1, len(LETTERS) + 1).select(
        F.col("id").cast("int").alias("token_no"), F.lit(1).alias("page")
    )
    following = productive.select("token_no", (F.col("page") + 1).alias("page"))
    gaps = starts.unionByName(following).join(productive, ["token_no", "page"], "left_anti")
    ends = gaps.groupBy("token_no").agg((F.min("page") - 1).alias("n"))
    return {r["token_no"]: r["n"] for r in ends.orderBy("token_no").collect()}

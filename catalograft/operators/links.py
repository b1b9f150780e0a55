"""Link and heading extraction over a table of captured pages.

Every operator takes `pages` with an `html` column and keeps the other columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalograft.functions.markup import (
    closing_position,
    first_per_key,
    is_link,
    link_target,
    runs_before,
    segments_at,
    with_marks,
)
from catalograft.functions.stages import bind, built_once, exploded, pinned
from catalograft.functions.text import join_runs, strip_ws


def _kept(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c != "html"]


def links_in(marks: Column, prefixes: Iterable[str]) -> Column:
    """Distinct link targets among the marks in first-seen order."""
    prefixes = tuple(prefixes)
    return F.array_distinct(
        F.transform(F.filter(marks, lambda m: is_link(m, prefixes)), link_target)
    )


def link_arrays(pages: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """One row per page with `links`: its distinct link targets in order."""
    marked = with_marks(pages, ("a",), text=False)
    return pinned(marked, _kept(pages), links=links_in(F.col("marks"), prefixes))


def collect_links(pages: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """Distinct link targets per page in first-seen order, as (…, pos, href)."""
    marked = with_marks(pages, ("a",), text=False)
    return exploded(marked, _kept(pages), links_in(F.col("marks"), prefixes), "href")


@built_once
def _closed_links(anchors: str) -> Column:
    found = F.transform(
        F.col(anchors),
        lambda seg, i: bind(
            closing_position(seg, "a"),
            lambda closing: F.struct(
                link_target(seg[0]).alias("href"),
                i.alias("pos"),
                F.when(
                    closing > 0, strip_ws(F.array_join(runs_before(seg, closing), ""))
                ).alias("text"),
            ),
        ),
    )
    return F.filter(found, lambda link: link["text"].isNotNull())


def named_links_in(marked: DataFrame, prefixes: Iterable[str], out: str) -> DataFrame:
    """Add `out`: ordered (href, pos, text) of the page's marks, distinct by href.

    Only a matching anchor opens; an anchor that is not closed before the next
    matching one is lost; the first closed anchor of a target wins even when its
    text is empty.
    """
    prefixes = tuple(prefixes)
    cut = segments_at(marked, lambda m: is_link(m, prefixes), "_anchors")
    links = cut.withColumn(out, _closed_links("_anchors")).drop("_anchors")
    return first_per_key(links, out, "href", "pos")


def named_link_arrays(pages: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """One row per page with `links`, see `named_links_in`."""
    marked = with_marks(pages, ("a",))
    linked = named_links_in(marked, prefixes, "links")
    return pinned(linked, _kept(pages), links=F.col("links"))


def collect_named_links(pages: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """Named links per page, as (…, pos, href, text)."""
    kept = _kept(pages)
    links = exploded(named_link_arrays(pages, prefixes), kept, F.col("links"), "link")
    return links.select(*kept, "pos", "link.href", "link.text")


def h1_title(pages: DataFrame) -> DataFrame:
    """Text of the last non-empty h1 of each page, as (…, title)."""
    marked = with_marks(pages, ("h1",))
    cut = segments_at(marked, lambda m: m["kind"] == "h1", "headings")
    return cut.select(*_kept(pages), last_heading(F.col("headings")).alias("title"))


def last_heading(headings: Column) -> Column:
    """Last non-empty text among heading segments."""
    texts = F.transform(
        headings,
        lambda seg: bind(
            closing_position(seg, "h1"), lambda closing: join_runs(runs_before(seg, closing))
        ),
    )
    return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(-1))


def meta_items(marks: Column) -> Column:
    """(key, pos, content) of every usable meta, content trimmed."""
    usable = F.filter(
        marks,
        lambda m: (m["kind"] == "meta") & (m["key"] != "") & (F.coalesce(m["value"], F.lit("")) != ""),
    )
    return F.transform(
        usable,
        lambda m, i: F.struct(
            m["key"].alias("key"), (-i).alias("pos"), strip_ws(m["value"]).alias("content")
        ),
    )


def meta_map(pages: DataFrame) -> DataFrame:
    """Meta keys and contents per page, as (…, meta map); the last write wins."""
    marked = with_marks(pages, ("meta",), text=False)
    items = marked.select(*_kept(pages), meta_items(F.col("marks")).alias("items"))
    # positions count down, so the first item per key is the last one on the page
    last = first_per_key(items, "items", "key", "pos")
    entries = F.transform("items", lambda x: F.struct(x["key"], x["content"]))
    return last.select(*_kept(pages), F.map_from_entries(entries).alias("meta"))


def jsonld_bodies(marks: Column) -> Column:
    """Trimmed, non-empty bodies of closed JSON-LD scripts in page order."""
    scripts = F.filter(
        marks,
        lambda m: (m["kind"] == "script")
        & F.coalesce(m["key"] == "application/ld+json", F.lit(False))
        & m["closed"],
    )
    return F.filter(F.transform(scripts, lambda m: strip_ws(m["text"])), lambda b: b != "")


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """JSON-LD blocks of each page, as (…, pos, block)."""
    marked = with_marks(pages, ("script",), text=False)
    return exploded(marked, _kept(pages), jsonld_bodies(F.col("marks")), "block")

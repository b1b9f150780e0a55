"""A store of captured pages, hashed by address so that lookups leave bodies where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalograft.session import settle
from catalograft.sources.store import CatalogStore, StoreVersion

TABLE = "captures"
#: Segments of a bucket beyond which it is rewritten as one.
MOST_SEGMENTS = 8


def newest_of(pages: DataFrame) -> DataFrame:
    """One capture per address, the newest, with or without body; a null page_id is the oldest.

    Of copies of one capture (same address and page_id) any body counts, a missing one last. The
    choice is made on narrow columns; a key no two captures share brings the bodies.
    """
    chosen = pages.groupBy("url").agg(F.max("page_id").alias("newest")).select(F.col("url").alias("u"), "newest")
    same = (F.col("url").eqNullSafe(F.col("u"))) & F.col("page_id").eqNullSafe(F.col("newest"))
    kept = pages.join(chosen, same, "left_semi")
    # copies of a capture meet as partial aggregates
    return kept.groupBy("url", "page_id").agg(F.max("html").alias("html")).select("page_id", "url", "html")


def add_captures(store: CatalogStore, pages: DataFrame, most_segments: int = MOST_SEGMENTS) -> StoreVersion:
    """Append pages (page_id, url, html) to the captures of a store and commit.

    A batch becomes one segment of each bucket it touches, with one capture per address, and only
    those newer than what the store has: an older or repeated one would never count. So
    an address has at most as many captures as its bucket has segments. Buckets with more than
    `most_segments` are rewritten with the newest capture of each address; others stay.
    """
    version = store.begin()
    batch = settle(newest_of(pages))
    known = version.read(TABLE, version.touched(TABLE, batch))
    known = known.groupBy(F.col("url").alias("k")).agg(F.max("page_id").alias("seen"))
    stale = F.col("page_id").isNull() | F.coalesce(F.col("page_id") <= F.col("seen"), F.lit(False))
    version.append(TABLE, batch.join(known, F.col("url").eqNullSafe(F.col("k")) & stale, "left_anti"))
    crowded = [int(b) for b, f in version.state.tables.get(TABLE, {}).items() if len(f) > most_segments]
    if crowded:
        version.write(TABLE, newest_of(version.read(TABLE, crowded)), crowded)
    version.commit()
    return version


def captured_pages(store: CatalogStore, version: int | None = None) -> DataFrame:
    """The captures of a store with their `bucket`, as `sources.pages.current`, `lookup_pages`, the jobs and
    walks take them: the choice by address and the join of bodies need no exchange of bodies."""
    return store.clustered(TABLE, version)

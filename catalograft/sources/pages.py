"""Captured pages: reading, streaming, decoding bodies, looking pages up by address."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalograft.schemas import BUCKET, PAGES


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def _charset_decoder():
    def decode_bytes(body: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series(
            [None if b is None else as_text(bytes(b), c) for b, c in zip(body, charset)],
            dtype="object",
        )

    def as_text(body: bytes, charset: str) -> str | None:
        try:
            return body.decode(charset, errors="replace")
        except (LookupError, ValueError):  # no such charset, or none for text
            return None

    return decode_bytes


def decode_body(body: Column, charset: Column) -> Column:
    """Body bytes as text; bad bytes become U+FFFD; the default charset is UTF-8.

    UTF-8 stays in the JVM; bodies in another charset go through an Arrow helper. A body in
    an unknown charset is null, like a failed fetch.
    """
    name = F.lower(F.coalesce(F.nullif(charset, F.lit("")), F.lit("utf-8")))
    is_utf8 = name.isin("utf-8", "utf8")
    decode_other = F.pandas_udf(_charset_decoder(), "string")
    return F.coalesce(
        F.when(is_utf8, F.make_valid_utf8(body.cast("string"))),
        decode_other(F.when(~is_utf8, body), name),
    )


def decode_captures(captures: DataFrame) -> DataFrame:
    """Pages of a capture log (page_id, url, status, body, charset).

    Anything but status 200 is a failed fetch: its html is null.
    """
    html = F.when(F.col("status") == 200, decode_body(F.col("body"), F.col("charset")))
    return captures.select("page_id", "url", html.alias("html"))


def current(pages: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """The capture that counts for each address (of `urls`, if given): the newest, if it has a body.

    A newest capture without body means that the page is missing, whatever was captured
    before. The choice is made on narrow columns; bodies are then joined by address
    and page_id, a key no two captures share, so copies of one page do not meet in one
    task and only bodies that count go on to be parsed. A null page_id is the oldest.

    Pages of a capture store carry their `bucket`: they are hashed by address already, and hold
    few captures of one, so bodies are joined by address alone and stay where they are.
    """
    kept = [c for c in pages.columns if c != BUCKET]
    narrow = pages.select("url", "page_id")
    if urls is not None:
        narrow = narrow.join(urls.select("url").distinct(), "url", "left_semi")
    chosen = narrow.groupBy("url").agg(F.max("page_id").alias("page_id"))
    chosen = chosen.select(F.col("url").alias("__url"), F.col("page_id").alias("__page_id"))
    page_id, newest = F.col("page_id"), F.col("__page_id")
    if BUCKET in pages.columns:
        # none is newer than the newest: no second key, which would ask for another exchange
        which = newest.isNull() | (page_id >= newest)
    else:
        which = page_id.eqNullSafe(newest)
    counted = pages.join(chosen, (F.col("url") == F.col("__url")) & which, "left_semi").select(*kept)
    return counted.where(F.col("html").isNotNull())


def lookup_pages(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """`urls` with page_id, html and `found`; a page without body is not found."""
    bodies = current(pages, urls).select("url", "page_id", "html")
    return urls.join(bodies, "url", "left").withColumn("found", F.col("html").isNotNull())

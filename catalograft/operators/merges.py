"""Upserts: field-wise merge rules over full tables.

Each merge first reduces its batch to one row per address, so that many copies of
one address meet as partial aggregates, and then joins on the address. The result
is the whole new table plus `action` (insert, update, keep). A store passes only the
buckets the batch touches, and `last_id`, the highest id of the whole table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalograft.operators.ids import with_dense_ids

EXTRACTED = (
    "name",
    "brand",
    "description",
    "image_url",
    "rating_value",
    "rating_count",
    "categories",
    "json_ld",
)


def timestamp(now: dt.datetime) -> Column:
    """A UTC time as a timestamp without zone, cut to seconds."""
    if now.tzinfo is not None:
        now = now.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(now.replace(microsecond=0).isoformat(sep=" ")).cast("timestamp_ntz")


def inserted_count(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("action") == "insert").alias("inserted"))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _first(value: Column, order: str) -> Column:
    """First non-null value in batch order."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def _last(value: Column, order: str) -> Column:
    """Last non-null value in batch order."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def _max_id(table: DataFrame) -> int:
    return table.agg(F.max("id").alias("id")).first()["id"] or 0


def _new_rows(old: DataFrame, batch: DataFrame, last_id: int | None) -> DataFrame:
    """Batch rows of unknown address with ids that continue the table's."""
    unknown = batch.join(old.select("url"), "url", "left_anti")
    return with_dense_ids(unknown, "ord", _max_id(old) if last_id is None else last_id)


def _together(old: DataFrame, updated: DataFrame, inserted: DataFrame) -> DataFrame:
    columns = [*old.columns, "action"]
    return updated.select(*columns).unionByName(
        inserted.withColumn("action", F.lit("insert")).select(
            *(
                F.col(c).cast(old.schema[c].dataType).alias(c) if c in old.columns else F.col(c)
                for c in columns
            )
        )
    )


def merge_brands(
    old: DataFrame, incoming: DataFrame, now: dt.datetime, last_id: int | None = None
) -> DataFrame:
    """Brands from a batch (ord, name, url).

    A known brand takes the batch's last non-empty name; a new one is inserted with
    it, or with its first name if all are empty.
    """
    batch = incoming.groupBy("url").agg(
        F.min("ord").alias("ord"),
        F.min_by("name", "ord").alias("first_name"),
        _last(_filled(F.col("name")), "ord").alias("new_name"),
    )
    renames = F.col("new_name").isNotNull() & (F.col("new_name") != F.col("name"))
    updated = (
        old.join(batch.select("url", "new_name"), "url", "left")
        .withColumn("action", F.when(renames, "update").otherwise("keep"))
        .withColumn("name", F.coalesce("new_name", "name"))
    )
    inserted = (
        _new_rows(old, batch, last_id)
        .withColumn("name", F.coalesce("new_name", "first_name", F.lit("")))
        .withColumn("discovered_at", timestamp(now))
        .withColumn("processed_at", F.lit(None))
    )
    return _together(old, updated, inserted)


def merge_queued_products(
    old: DataFrame, incoming: DataFrame, brands: DataFrame, now: dt.datetime, last_id: int | None = None
) -> DataFrame:
    """Queue products found for brands, from a batch (ord, brand_id, url, name).

    A known product keeps a non-empty name and takes the latest brand; a new one is
    inserted with its first non-empty name and latest brand.
    """
    named = incoming.join(
        brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name")),
        "brand_id",
        "left",
    )
    batch = named.groupBy("url").agg(
        F.min("ord").alias("ord"),
        F.min_by("name", "ord").alias("first_name"),
        _first(_filled(F.col("name")), "ord").alias("new_name"),
        F.max_by("brand_id", "ord").alias("new_brand_id"),
        F.min_by("brand_name", "ord").alias("first_brand_name"),
        _last(_filled(F.col("brand_name")), "ord").alias("new_brand_name"),
    )
    known = F.col("new_brand_id").isNotNull()
    updated = (
        old.join(batch.select("url", "new_name", "new_brand_id", "new_brand_name"), "url", "left")
        .withColumn("action", F.when(known, "update").otherwise("keep"))
        .withColumn("name", F.coalesce(_filled(F.col("name")), "new_name", "name"))
        .withColumn("brand_id", F.coalesce("new_brand_id", "brand_id"))
        .withColumn("brand_name", F.coalesce("new_brand_name", "brand_name"))
    )
    inserted = (
        _new_rows(old, batch, last_id)
        .withColumn("name", F.coalesce("new_name", "first_name"))
        .withColumn("brand_id", F.col("new_brand_id"))
        .withColumn("brand_name", F.coalesce("new_brand_name", "first_brand_name"))
        .withColumn("discovered_at", timestamp(now))
    )
    empty = [c for c in old.columns if c not in inserted.columns]
    inserted = inserted.withColumns({c: F.lit(None) for c in empty})
    return _together(old, updated, inserted)


def merge_products(
    old: DataFrame, extracted: DataFrame, now: dt.datetime, order: str = "page_id", last_id: int | None = None
) -> DataFrame:
    """Save extracted products.

    Name and brand keep the old value when the new one is null (an empty string
    counts as a value); every other extracted field is replaced, also by null. A new
    product has no brand id. Several rows for one address apply in `order`.
    """
    replaced = [c for c in EXTRACTED if c not in ("name", "brand")]
    batch = extracted.groupBy("url").agg(
        F.min(order).alias("ord"),
        _last(F.col("name"), order).alias("new_name"),
        _last(F.col("brand"), order).alias("new_brand"),
        F.max_by(F.struct(*replaced), order).alias("new"),
    )
    saved = F.col("new").isNotNull()
    updated = (
        old.join(batch.drop("ord"), "url", "left")
        .withColumn("action", F.when(saved, "update").otherwise("keep"))
        .withColumn("name", F.coalesce("new_name", "name"))
        .withColumn("brand_name", F.coalesce("new_brand", "brand_name"))
        .withColumn("scraped_at", F.when(saved, timestamp(now)).otherwise(F.col("scraped_at")))
        .withColumns({c: F.when(saved, F.col(f"new.{c}")).otherwise(F.col(c)) for c in replaced})
    )
    inserted = (
        _new_rows(old, batch, last_id)
        .withColumn("name", F.col("new_name"))
        .withColumn("brand_name", F.col("new_brand"))
        .withColumn("brand_id", F.lit(None))
        .withColumn("discovered_at", timestamp(now))
        .withColumn("scraped_at", timestamp(now))
        .withColumns({c: F.col(f"new.{c}") for c in replaced})
    )
    return _together(old, updated, inserted)


def replace_ingredients(old: DataFrame, saved: DataFrame) -> DataFrame:
    """Replace the rosters of the saved products (product_id, ingredients).

    An empty roster clears the product's rows.
    """
    entry = F.col("entry")
    new = saved.select("product_id", F.explode_outer("ingredients").alias("entry")).where(
        entry.isNotNull()
    )
    rows = new.select(
        "product_id",
        entry["position"].alias("position"),
        entry["url"].alias("ingredient_url"),
        entry["name"].alias("ingredient_name"),
        entry["extra"].alias("extra"),
    )
    untouched = old.join(saved.select("product_id").distinct(), "product_id", "left_anti")
    return untouched.select(*rows.columns).unionByName(rows)


def _mark(table: DataFrame, ids: DataFrame, column: str, now: dt.datetime) -> DataFrame:
    marked = ids.select("id").distinct().withColumn("_marked", F.lit(True))
    return (
        table.join(marked, "id", "left")
        .withColumn(column, F.when(F.col("_marked"), timestamp(now)).otherwise(F.col(column)))
        .select(*table.columns)
    )


def mark_processed(brands: DataFrame, ids: DataFrame, now: dt.datetime) -> DataFrame:
    """Set `processed_at` of the brands in `ids`, whether or not they gave products."""
    return _mark(brands, ids, "processed_at", now)


def mark_scraped(products: DataFrame, ids: DataFrame, now: dt.datetime) -> DataFrame:
    """Set `scraped_at` of the products in `ids`."""
    return _mark(products, ids, "scraped_at", now)

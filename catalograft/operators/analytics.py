"""Roll-ups over the stored catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_product(product_ingredients: DataFrame) -> DataFrame:
    """(product_id, ingredient, position): a product names an ingredient once, by lower-cased name.

    Rosters clustered by product stay where they are: the group's keys hold the product.
    """
    name = F.lower(F.trim("ingredient_name"))
    named = product_ingredients.withColumn("ingredient", name).where(F.col("ingredient") != "")
    return named.groupBy("product_id", "ingredient").agg(F.min("position").alias("position"))


def ingredient_frequency(product_ingredients: DataFrame) -> DataFrame:
    """(ingredient, products, best_position) by lower-cased name; unnamed entries are left out."""
    return (
        _per_product(product_ingredients)
        .groupBy("ingredient")
        .agg(F.count("*").alias("products"), F.min("position").cast("long").alias("best_position"))
    )


def top_ingredients(product_ingredients: DataFrame, k: int) -> DataFrame:
    """The `k` ingredients of most products, exact; ties by name.

    Counts meet as partial sums per ingredient; of the sums each task keeps its `k` best.
    """
    return ingredient_frequency(product_ingredients).orderBy(F.desc("products"), "ingredient").limit(k)


def brand_ingredients(products: DataFrame, product_ingredients: DataFrame) -> DataFrame:
    """(brand, products, ingredients, mentions) by brand name: its products, the distinct named ingredients
    of all of them, and how often a product names one. Null is a group; a brand without rosters has 0.

    An ingredient of a large brand is counted by (brand, ingredient) before the brand's rows meet,
    so no task gets all rosters of a brand.
    """
    brand = F.col("brand_name").alias("brand")
    per_brand = products.groupBy(brand).agg(F.countDistinct("id").alias("products"))
    named = _per_product(product_ingredients).select(F.col("product_id").alias("id"), "ingredient")
    pairs = products.select("id", brand).distinct().join(named, "id").groupBy("brand", "ingredient").agg(F.count("*").alias("n"))
    counted = pairs.groupBy(F.col("brand").alias("b")).agg(F.count("*").alias("ingredients"), F.sum("n").alias("mentions"))
    joined = per_brand.join(counted, F.col("brand").eqNullSafe(F.col("b")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("brand", "products", F.coalesce("ingredients", zero).alias("ingredients"), F.coalesce("mentions", zero).alias("mentions"))


def brand_rollup(products: DataFrame) -> DataFrame:
    """(brand, products, extracted, rated, mean_rating) by brand name; null is a group."""
    return products.groupBy(F.col("brand_name").alias("brand")).agg(
        F.count("*").alias("products"),
        F.count("scraped_at").alias("extracted"),
        F.count("rating_value").alias("rated"),
        F.avg("rating_value").alias("mean_rating"),
    )


def field_fill(products: DataFrame) -> DataFrame:
    """(field, filled, total): how many rows have a value that is not null or empty."""

    def filled(field: str, kind: str):
        there = F.col(field).isNotNull()
        if kind == "string":
            there &= F.col(field) != ""
        elif kind.startswith("array"):
            there &= F.size(field) > 0
        return F.struct(F.lit(field).alias("field"), F.count_if(there).alias("filled"))

    counted = products.agg(
        F.count("*").alias("total"), F.array(*(filled(f, k) for f, k in products.dtypes)).alias("fields")
    )
    return counted.select(F.explode("fields").alias("f"), "total").select("f.field", "f.filled", "total")

"""JSON text columns for export, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = r"[\x00-\x7e]+|[^\x00-\x7e]"


def _ascii_only(text: Column) -> Column:
    """Write characters above ASCII as \\uXXXX escapes of their UTF-16 units."""

    def escaped(piece: Column) -> Column:
        units = F.lower(F.hex(F.encode(piece, "UTF-16BE")))
        return F.when(piece.rlike(r"^[\x00-\x7e]"), piece).otherwise(
            F.regexp_replace(units, "(.{4})", r"\\u$1")
        )

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.when(~text.rlike(r"[^\x00-\x7e]"), text).otherwise(
        F.array_join(F.transform(pieces, escaped), "")
    )


def _json_string(text: Column) -> Column:
    """`text` as a JSON string with its quotes."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, _json_string), ", "), F.lit("]"))


def _json_object(entries: Column) -> Column:
    def member(entry: Column) -> Column:
        return F.concat(_json_string(entry["key"]), F.lit(": "), _json_string(entry["value"]))

    members = F.array_join(F.transform(F.map_entries(entries), member), ", ")
    return F.concat(F.lit("{"), members, F.lit("}"))


def to_storage_json(products: DataFrame) -> DataFrame:
    """Categories as a JSON list in ASCII, "[]" when empty; an empty node as null."""
    listed = _json_list(F.coalesce("categories", F.array().cast("array<string>")))
    return products.withColumns(
        {
            "categories": _ascii_only(listed),
            "json_ld": F.nullif(F.nullif("json_ld", F.lit("")), F.lit("{}")),
        }
    )


def to_storage_extra(product_ingredients: DataFrame) -> DataFrame:
    """The extra map as a JSON object, null when empty."""
    return product_ingredients.withColumn(
        "extra", F.when(F.size("extra") > 0, _json_object(F.col("extra")))
    )


def from_storage_json(products: DataFrame) -> DataFrame:
    """Null or empty categories read as an empty list, an empty node as null."""
    return products.withColumns(
        {
            "categories": F.coalesce(
                F.from_json(F.nullif("categories", F.lit("")), "array<string>"),
                F.array().cast("array<string>"),
            ),
            "json_ld": F.nullif("json_ld", F.lit("")),
        }
    )


def from_storage_extra(product_ingredients: DataFrame) -> DataFrame:
    """Null or empty extra reads as an empty map."""
    return product_ingredients.withColumn(
        "extra",
        F.coalesce(
            F.from_json(F.nullif("extra", F.lit("")), "map<string,string>"),
            F.create_map().cast("map<string,string>"),
        ),
    )

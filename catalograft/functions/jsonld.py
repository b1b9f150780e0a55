"""JSON-LD: choosing the product node of a page and reading its fields.

A block whose root object is the product, a root list or `@graph` whose first product is
one of its items, and a block that cannot hold a product are decided in the JVM. Only the
rest goes to an Arrow helper that walks the document in order, because variant objects
come back with their keys sorted.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalograft.functions.stages import bind
from catalograft.functions.text import split_list, strip_ws
from catalograft.functions.urls import root_join

# The node types that describe a product, and the ingredient keys.
PRODUCT_TYPES = ("Product", "ProductGroup")
INGREDIENT_KEYS = ("hasIngredient", "ingredient", "ingredients")

_TYPE_NOT_SCALAR = r'"@type"\s*:\s*[\[{]'
# escapes that may hide a key or a type, and numbers whose text another writer may change
_HIDES = r"\\u00[2-7]|[0-9][eE][+-]?[0-9]|[0-9.]{16}|Infinity|NaN"
_FALSY = ("null", "false", '""', "[]", "{}")
_ZERO = r"^-?0(?:\.0*)?(?:[eE].*)?$"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT_TEXT = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)
_INT_TEXT = rf"^[+-]?{_DIGITS}$"

TYPE_ERROR = "json-ld: @type is not a plain value"
NAME_ERROR = "json-ld: ingredient name is not text"
COUNT_ERROR = "json-ld: ratingCount is infinite"
UNREAD_ERROR = "json-ld: the product cannot be read back"


def block_states(blocks: Column) -> Column:
    """(verdict, node) per block: "none", "root" or "open" when a walk is needed."""

    def state(block: Column) -> Column:
        impossible = ~block.contains("Product") & ~block.contains("\\u")
        plain_types = ~block.rlike(_TYPE_NOT_SCALAR)
        wrapped = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))

        def judged(v: Column) -> Column:
            alone = F.try_variant_get(v, "$[1]", "variant").isNull()
            rooted = _is_product(v, '$[0]["@type"]') & alone
            plain = plain_types & ~block.rlike(_HIDES) & alone
            return F.when(rooted, block).when(plain, _listed_product(block, v))

        node = F.when(impossible & plain_types, F.lit("")).otherwise(bind(wrapped, judged))
        return bind(
            node,
            lambda n: F.struct(
                F.when(n == "", "none").when(n.isNotNull(), "root").otherwise("open").alias("verdict"),
                F.coalesce(F.nullif(n, F.lit("")), block).alias("node"),
            ),
        )

    return F.transform(blocks, state)


def _is_product(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string").isin(*PRODUCT_TYPES), F.lit(False))


def _listed_product(block: Column, v: Column) -> Column:
    """Text of the first item of a root list or of the root's `@graph` that is a product.

    Null if something that comes before it, or a member beside the `@graph`, may hold a
    product as well: document order then decides.
    """

    def may_hold(value: Column) -> Column:
        return F.to_json(value).contains("Product")

    def first(items: Column, path: str) -> Column:
        def at(place: Column) -> Column:
            clear = ~F.exists(F.slice(items, F.lit(1), F.greatest(place - 1, F.lit(0)).cast("int")), may_hold)
            text = F.call_function("get_json_object", block, F.concat(F.lit(path + "["), (place - 1).cast("string"), F.lit("]")))
            return F.when((place > 0) & clear, text)

        return bind(F.array_position(F.transform(items, lambda i: _is_product(i, '$["@type"]')), F.lit(True)), at)

    members = F.try_variant_get(v, "$[0]", "map<string,variant>")
    beside = F.exists(F.map_values(F.map_filter(members, lambda k, _: k != "@graph")), may_hold)
    graph = F.try_variant_get(v, '$[0]["@graph"]', "array<variant>")
    return F.coalesce(
        bind(graph, lambda g: F.when(g.isNotNull() & ~beside, first(g, "$.@graph"))),
        bind(F.try_variant_get(v, "$[0]", "array<variant>"), lambda a: F.when(a.isNotNull(), first(a, "$"))),
    )


def _block_walker():
    """The Arrow helper; its functions are local so that workers need no import of ours."""
    types, type_error, count_error = frozenset(PRODUCT_TYPES), TYPE_ERROR, COUNT_ERROR

    class Odd(str):
        """A number no double can hold; it stays as its text."""

    def whole(text):
        return int(text) if len(text) < 300 else Odd(text)

    def real(text):
        return Odd(text) if math.isinf(float(text)) else float(text)

    def infinite_count(node):
        rating = node.get("aggregateRating")
        count = rating.get("ratingCount") if isinstance(rating, dict) else None
        # a whole number of any length is not infinite
        return isinstance(count, Odd) and count.lstrip("-") != "NaN" and not count.lstrip("-").isdigit()

    def first_product(document):
        """First product object of a parsed document in document order."""
        waiting = [document]
        while waiting:
            node = waiting.pop()
            if isinstance(node, dict):
                if node.get("@type") in types:
                    return node
                waiting.extend(reversed(node.values()))
            elif isinstance(node, list):
                waiting.extend(reversed(node))
        return None

    def as_text(node):
        text = json.dumps(node, ensure_ascii=False)
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:  # a lone surrogate stays an escape
            return json.dumps(node)
        return text

    def walk(blocks):
        for block in blocks:
            try:
                document = json.loads(block, parse_constant=Odd, parse_float=real, parse_int=whole)
            except json.JSONDecodeError:
                continue
            except RecursionError:
                return None, "json-ld: nested too deeply"
            try:
                node = first_product(document)
            except TypeError:
                return None, type_error
            if node and infinite_count(node):
                return as_text(node), count_error
            if node:
                return as_text(node), None
        return None, None

    def walk_blocks(blocks: pd.Series) -> pd.DataFrame:
        found = [(None, None) if b is None else walk(b) for b in blocks]
        return pd.DataFrame(found, columns=["node", "error"], dtype="object")

    return walk_blocks


_NODE = T.StructType(
    [T.StructField("node", T.StringType()), T.StructField("error", T.StringType())]
)


def walk_blocks(blocks: Column) -> Column:
    """(node, error) of pages whose blocks need a walk; null rows pass through."""
    return F.pandas_udf(_block_walker(), _NODE)(blocks)


# The members of a product node that are read.
MEMBERS = {
    "name": "$.name",
    "brand": "$.brand",
    "brand_name": "$.brand.name",
    "brand_brand": "$.brand.brand",
    "description": "$.description",
    "image": "$.image",
    "image_0": "$.image[0]",
    "rating": "$.aggregateRating",
    "rating_value": "$.aggregateRating.ratingValue",
    "rating_count": "$.aggregateRating.ratingCount",
    "category": "$.category",
    **{key: f"$.{key}" for key in INGREDIENT_KEYS},
}


def raw_members(v: Column) -> Column:
    """JSON text of every member; its first character tells the type."""
    return F.struct(
        *(_raw(v, path).alias(name) for name, path in MEMBERS.items())
    )


def _raw(v: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


class Node:
    """Reads members of the product node: a variant column and its raw members."""

    def __init__(self, v: Column, raws: Column):
        self.v, self.raws = v, raws

    def raw(self, member: str) -> Column:
        return self.raws[member]

    def get(self, member: str, kind: str) -> Column:
        return F.try_variant_get(self.v, MEMBERS[member], kind)

    def filled(self, member: str) -> Column:
        """Text of a member unless it is missing, null, false, zero or empty."""
        return F.when(is_filled(self.raw(member)), self.get(member, "string"))


def is_filled(raw: Column) -> Column:
    return F.coalesce(~raw.isin(*_FALSY) & ~raw.rlike(_ZERO), F.lit(False))


def is_string(raw: Column) -> Column:
    return F.coalesce(raw.startswith('"'), F.lit(False))


def is_object(raw: Column) -> Column:
    return F.coalesce(raw.startswith("{"), F.lit(False))


def is_array(raw: Column) -> Column:
    return F.coalesce(raw.startswith("["), F.lit(False))


def brand(node: Node) -> Column:
    """Object: its name, else its brand; text: itself; anything else: nothing."""
    raw = node.raw("brand")
    return F.when(
        is_object(raw), F.coalesce(node.filled("brand_name"), node.filled("brand_brand"))
    ).when(is_string(raw), node.get("brand", "string"))


def first_image(node: Node) -> Column:
    """First of a list, or the value itself."""
    return F.when(is_array(node.raw("image")), node.filled("image_0")).otherwise(
        node.filled("image")
    )


def _number(node: Node, member: str, pattern: str, kind: str) -> Column:
    """A rating member: text must match the pattern, a number is cast."""
    raw = node.raw(member)
    text = strip_ws(node.get(member, "string"))
    parsed = F.when(
        text.rlike(pattern), F.replace(text, F.lit("_"), F.lit("")).try_cast(kind)
    )
    return F.when(
        is_object(node.raw("rating")) & raw.isNotNull(),
        F.when(is_string(raw), parsed).when(
            ~is_object(raw) & ~is_array(raw), node.get(member, kind)
        ),
    )


def rating_value(node: Node) -> Column:
    return _number(node, "rating_value", _FLOAT_TEXT, "double")


def rating_count(node: Node) -> Column:
    """Text must be a whole number; a number is cut to its whole part."""
    return _number(node, "rating_count", _INT_TEXT, "bigint")


def rating_count_infinite(node: Node) -> Column:
    # as JSON text an infinite number looks like a string, so ask for the type
    number = (F.schema_of_variant(node.get("rating_count", "variant")) == "DOUBLE") & (
        F.abs(node.get("rating_count", "double")) == float("inf")
    )
    return F.coalesce(node.raw("rating_count").contains("Infinity") & number, F.lit(False))


def categories(node: Node) -> Column:
    """List: every item as text; text: one item; anything else: empty."""
    raw = node.raw("category")

    def as_text(item: Column) -> Column:
        return bind(
            F.to_json(item),
            lambda shown: F.when(shown == "null", "None")
            .when(shown == "true", "True")
            .when(shown == "false", "False")
            .otherwise(F.try_variant_get(item, "$", "string")),
        )

    return (
        F.when(is_array(raw), F.transform(node.get("category", "array<variant>"), as_text))
        .when(is_string(raw), F.array(node.get("category", "string")))
        .otherwise(F.array().cast("array<string>"))
    )


def ingredient_payload(node: Node) -> Column:
    """The first filled member among the ingredient keys, as a variant."""
    return F.coalesce(
        *(F.when(is_filled(node.raw(key)), node.get(key, "variant")) for key in INGREDIENT_KEYS)
    )


def json_mentions(payload: Column, base: str) -> Column:
    """Ordered (name, url, failed) of the ingredient payload.

    Objects need a name and may carry an address; strings are names; a single
    string is a comma-separated list. Other items are skipped.
    """

    def mention(name: Column, url: Column, failed: Column) -> Column:
        return F.struct(name.alias("name"), url.alias("url"), failed.alias("failed"))

    def from_object(item: Column) -> Column:
        def text(path: str) -> Column:
            return F.try_variant_get(item, path, "string")

        def named(raws: Column) -> Column:
            own, other = raws["own"], raws["url"]
            paths = {"name": "$.name", "own": '$["@id"]', "identifier": "$.identifier"}
            name = F.coalesce(*(F.when(is_filled(raws[m]), text(p)) for m, p in paths.items()))
            name_raw = F.coalesce(*(F.when(is_filled(raws[m]), raws[m]) for m in paths))
            url = (
                F.when(is_filled(own) & is_string(own), root_join(text('$["@id"]'), base))
                .when(~is_filled(own) & is_string(other), root_join(text("$.url"), base))
                .otherwise("")
            )
            return F.when(name.isNotNull(), mention(name, url, ~is_string(name_raw)))

        raws = F.struct(
            _raw(item, "$.name").alias("name"),
            _raw(item, '$["@id"]').alias("own"),
            _raw(item, "$.identifier").alias("identifier"),
            _raw(item, "$.url").alias("url"),
        )
        return bind(raws, named)

    def from_item(item: Column) -> Column:
        plain = mention(F.try_variant_get(item, "$", "string"), F.lit(""), F.lit(False))
        return bind(
            F.to_json(item),
            lambda raw: F.when(is_string(raw), plain).when(is_object(raw), from_object(item)),
        )

    listed = F.filter(
        F.transform(F.try_variant_get(payload, "$", "array<variant>"), from_item),
        lambda m: m.isNotNull(),
    )
    separated = F.transform(
        split_list(F.try_variant_get(payload, "$", "string")),
        lambda name: mention(name, F.lit(""), F.lit(False)),
    )
    chosen = bind(
        F.to_json(payload),
        lambda raw: F.when(is_array(raw), listed).when(is_string(raw), separated),
    )
    return F.coalesce(
        chosen, F.array().cast("array<struct<name:string,url:string,failed:boolean>>")
    )

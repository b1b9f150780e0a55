"""Product extraction: one output row per captured page, without a shuffle.

The page's marks are turned into headings, metas, JSON-LD blocks and ingredient
mentions inside the page's own row; mentions are folded by identity and then
merged by name with sorted arrays. Only the product node of unusual JSON-LD goes
through Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalograft.functions import jsonld
from catalograft.functions.markup import (
    anchor_segments,
    attributes_of,
    group_runs,
    page_tokens,
    segment_closed,
    segments_at,
    self_closed,
    tag_marks,
    text_runs,
    tokens,
)
from catalograft.functions.stages import bind, built_once, exploded, pinned
from catalograft.functions.text import blank_to_null, join_runs, strip_ws
from catalograft.functions.urls import has_prefix, humanize_slug, mention_key, root_join
from catalograft.operators.links import jsonld_bodies, meta_items

INGREDIENT_PREFIX = "/ingredients/"
BRAND_PREFIX = "/brand"
STRICT_BRAND_PREFIXES = ("/brand/", "/brands/")

#: What each field of a product is made from: parts of the page and values of its product node.
PARTS_OF = {
    "name": ("title", "metas", "blocks"),
    "brand": ("metas", "brands", "blocks"),
    "description": ("metas", "blocks"),
    "image_url": ("metas", "blocks"),
    "rating_value": ("blocks",),
    "rating_count": ("blocks",),
    "categories": ("blocks",),
    "ingredients": ("events", "blocks"),
    "json_ld": ("blocks",),
    "raw_brand_links": ("brands",),
    "extract_error": ("bad_script", "blocks"),
}
NODE_VALUES_OF = {
    "name": ("ld_name",),
    "brand": ("ld_brand",),
    "description": ("ld_description",),
    "image_url": ("ld_image",),
    "rating_value": ("rating_value",),
    "rating_count": ("rating_count",),
    "categories": ("categories",),
    "ingredients": ("payload",),
    "extract_error": ("count_infinite", "payload", "unread"),
}
PARTS = ("title", "metas", "blocks", "bad_script", "events", "brands")

_EVENT = "struct<key:string,setter:boolean,labelled:boolean,name:string,url:string>"


def _event(key: Column, setter: Column, labelled: Column, name: Column, url: Column) -> Column:
    return F.struct(
        key.alias("key"),
        setter.alias("setter"),
        labelled.alias("labelled"),
        name.alias("name"),
        url.alias("url"),
    )


def _anchors(segments: Column, base: str, prefixes: tuple[str, ...]) -> Column:
    """Anchors whose target has one of the prefixes, in order: href, label, address, text.

    The text is null when the anchor is not closed before the next one.
    """

    def may_match(segment: Column) -> Column:
        # a target is written as it is, or with references
        return reduce(lambda a, b: a | b, (segment.contains(p) for p in (*prefixes, "&")))

    def anchor(pieces: Column, values: Column) -> Column:
        closed = segment_closed(pieces)
        content = F.slice(pieces, F.lit(2), F.size(pieces))
        text = F.when(self_closed(pieces[0]), F.lit("")).when(
            closed, join_runs(text_runs(content))
        )
        return F.when(
            has_prefix(values[0], prefixes),
            F.struct(
                values[0].alias("href"),
                F.coalesce(blank_to_null(values[1]), blank_to_null(values[2])).alias("label"),
                root_join(values[0], base).alias("url"),
                text.alias("text"),
            ),
        )

    def read(segment: Column) -> Column:
        return bind(
            tokens(segment),
            lambda pieces: bind(
                attributes_of(pieces[0], "a"), lambda values: anchor(pieces, values)
            ),
        )

    return F.filter(F.transform(F.filter(segments, may_match), read), lambda a: a.isNotNull())


def _is_ingredient(anchor: Column) -> Column:
    return anchor["href"].startswith(INGREDIENT_PREFIX)


def _anchor_events(anchors: Column) -> Column:
    """Mention events of ingredient anchors: a label event at the start tag, a text
    event at the end tag."""

    def events(anchor: Column) -> Column:
        # the address is never empty here, so it is the key
        key, url, text = F.lower(anchor["url"]), anchor["url"], anchor["text"]
        label = anchor["label"]
        label_event = F.when(
            label.isNotNull(), _event(key, F.lit(True), F.lit(True), strip_ws(label), url)
        )
        named = F.when(text == "", humanize_slug(anchor["href"], "mention")).otherwise(text)
        text_event = F.when(
            text.isNotNull(), _event(key, text != "", F.lit(False), named, url)
        )
        return F.array(label_event, text_event)

    pairs = F.transform(F.filter(anchors, _is_ingredient), events)
    return F.filter(F.flatten(pairs), lambda e: e.isNotNull())


def _brand_anchors(anchors: Column) -> Column:
    """Ordered (url, text) of brand anchors; text is null when empty or unclosed."""
    return F.transform(
        F.filter(anchors, lambda a: ~_is_ingredient(a)),
        lambda a: F.struct(a["url"].alias("url"), blank_to_null(a["text"]).alias("text")),
    )


def _last_heading(headings: Column) -> Column:
    """Last non-empty text among token segments that start with an h1."""

    def text(segment: Column) -> Column:
        closing = F.array_position(
            F.transform(segment, lambda t: t.startswith("</")), F.lit(True)
        ).cast("int")
        inner = F.slice(segment, F.lit(2), F.greatest(closing - 2, F.lit(0)))
        return F.when(self_closed(segment[0]), F.lit("")).otherwise(join_runs(text_runs(inner)))

    return F.try_element_at(F.filter(F.transform(headings, text), lambda t: t != ""), F.lit(-1))


def page_parts(
    pages: DataFrame, base: str, strict_brand_prefix: bool = False, parts: tuple[str, ...] = PARTS
) -> DataFrame:
    """Raw parts of every page: title, metas, JSON-LD blocks, events and brand anchors, or some of them."""
    kept = [c for c in pages.columns if c != "html"]
    brand_prefixes = STRICT_BRAND_PREFIXES if strict_brand_prefix else (BRAND_PREFIX,)
    # an anchor nobody asked for is not read
    of_part = {"events": (INGREDIENT_PREFIX,), "brands": brand_prefixes}
    prefixes = tuple(p for part, own in of_part.items() if part in parts or not {*of_part} & {*parts} for p in own)
    anchored = bool({*of_part} & set(parts))
    marked = bool(set(parts) - {"events", "brands"})
    cuts = [c for c, on in (("tokens", marked), ("anchors", anchored)) if on]
    cut = pinned(
        pages.where(F.col("html").isNotNull()), kept, **_only(_cut_columns(base, prefixes), cuts)
    )
    if marked:
        cut = cut.withColumn("marks", tag_marks("tokens", ("meta", "script")))
    if "title" in parts:
        cut = segments_at(
            cut, lambda t: t.startswith("<") & t.rlike(r"(?i)^<h1[\s/>]"), "headings", "tokens"
        )
    return pinned(cut, kept, **_only(_part_columns(), parts))


def _only(columns: dict[str, Column], names) -> dict[str, Column]:
    return {name: columns[name] for name in names}


@built_once
def _cut_columns(base: str, prefixes: tuple[str, ...]) -> dict[str, Column]:
    html = F.col("html")
    return {
        "tokens": page_tokens(html, ("h1", "meta")),
        "anchors": _anchors(anchor_segments(html), base, prefixes),
    }


@built_once
def _part_columns() -> dict[str, Column]:
    marks, anchors = F.col("marks"), F.col("anchors")
    return {
        "title": _last_heading(F.col("headings")),
        "metas": meta_items(marks),
        "blocks": jsonld_bodies(marks),
        "bad_script": F.exists(marks, lambda m: (m["kind"] == "script") & m["key"].isNull()),
        "events": _anchor_events(anchors),
        "brands": _brand_anchors(anchors),
    }


def with_product_node(parts: DataFrame) -> DataFrame:
    """Replace `blocks` by `json_ld`, the page's product node as JSON text, and
    `node_error`."""
    kept = [c for c in parts.columns if c != "blocks"]
    judged = pinned(parts, [*kept, "blocks"], first=_verdict("blocks"))
    open_blocks = F.when(F.col("first.verdict") == "open", F.col("blocks"))
    walked = judged.withColumn("walked", jsonld.walk_blocks(open_blocks))
    return walked.select(
        *kept,
        F.when(F.col("first.verdict") == "root", F.col("first.node"))
        .otherwise(F.col("walked.node"))
        .alias("json_ld"),
        F.col("walked.error").alias("node_error"),
    )


@built_once
def _verdict(blocks: str) -> Column:
    states = jsonld.block_states(F.col(blocks))
    return F.get(F.filter(states, lambda s: s["verdict"] != "none"), 0)


def fold_mentions(df: DataFrame, events: str = "events", out: str = "folded") -> DataFrame:
    """Fold an ordered event array by key into `out`: (name_key, ord, name, url).

    The order is that of the first event. The first event always sets the name,
    later ones only if they are setters. A labelled event also sets the address.
    """
    kept = [c for c in df.columns if c != events]
    numbered = df.select(*kept, _numbered(events).alias("_events"))
    grouped = group_runs(numbered, "_events", "key", "_groups")
    return grouped.select(*kept, _folds("_groups").alias(out))


@built_once
def _numbered(events: str) -> Column:
    return F.transform(
        F.col(events),
        lambda e, i: F.struct(
            e["key"].alias("key"),
            i.alias("ord"),
            e["setter"].alias("setter"),
            e["labelled"].alias("labelled"),
            e["name"].alias("name"),
            e["url"].alias("url"),
        ),
    )


@built_once
def _folds(groups: str) -> Column:
    def fold(group: Column) -> Column:
        named = F.filter(group, lambda e, i: (i == 0) | e["setter"])
        labelled = F.filter(group, lambda e: e["labelled"])
        linked = F.filter(group, lambda e: e["url"] != "")
        url = F.coalesce(
            F.try_element_at(labelled, F.lit(-1))["url"], F.get(linked, 0)["url"], F.lit("")
        )
        return F.struct(
            group[0]["ord"].alias("ord"),
            F.element_at(named, -1)["name"].alias("name"),
            url.alias("url"),
        )

    def keyed(entry: Column) -> Column:
        # names are compared ignoring case; an empty name never merges
        name_key = F.when(
            entry["name"] == "", F.concat(F.lit("\x00"), entry["ord"])
        ).otherwise(F.lower(entry["name"]))
        return F.struct(
            name_key.alias("name_key"),
            entry["ord"].alias("ord"),
            entry["name"].alias("name"),
            entry["url"].alias("url"),
        )

    return F.transform(F.transform(F.col(groups), fold), keyed)


def merge_by_name(df: DataFrame, folded: str = "folded", out: str = "ingredients") -> DataFrame:
    """Merge folded mentions of equal name into the first; number them from 1."""
    kept = [c for c in df.columns if c != folded]
    grouped = group_runs(df, folded, "name_key", "_names")
    return grouped.select(*kept, _roster("_names").alias(out))


@built_once
def _roster(groups: str) -> Column:
    merged = F.transform(
        F.col(groups),
        lambda group: F.struct(
            group[0]["ord"].alias("ord"),
            group[0]["name"].alias("name"),
            F.coalesce(
                F.get(F.filter(group, lambda e: e["url"] != ""), 0)["url"], F.lit("")
            ).alias("url"),
        ),
    )
    return F.transform(
        F.sort_array(merged),
        lambda e, i: F.struct(
            (i + 1).alias("position"),
            e["name"].alias("name"),
            e["url"].alias("url"),
            F.create_map().cast("map<string,string>").alias("extra"),
        ),
    )


def _json_events(mentions: Column) -> Column:
    return F.transform(
        mentions,
        lambda m: _event(
            mention_key(m["url"], m["name"]), F.lit(False), F.lit(False), m["name"], m["url"]
        ),
    )


def _last_meta(metas: Column, key: str) -> Column:
    return F.try_element_at(F.filter(metas, lambda m: m["key"] == key), F.lit(-1))["content"]


def extract_products(
    pages: DataFrame,
    base: str,
    strict_brand_prefix: bool = False,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """One product per captured page (page_id, url, html) that has a body.

    `fields` names the columns wanted besides those of the pages (default: all, `PARTS_OF`); only the
    stages they need are built, as a generator's columns are not pruned later. `extract_error` is
    set for pages that must not be stored.
    """
    fields = tuple(PARTS_OF) if fields is None else tuple(fields)
    kept = [c for c in pages.columns if c != "html"]
    parts = tuple(p for p in PARTS if any(p in PARTS_OF[f] for f in fields))
    df = page_parts(pages, base, strict_brand_prefix, parts)
    if "blocks" in parts:
        df = with_product_node(df)
        values = tuple(dict.fromkeys(v for f in fields for v in NODE_VALUES_OF.get(f, ())))
        if values:
            read = df.withColumn("node", F.try_parse_json("json_ld"))
            raw = pinned(read, [*df.columns, "node"], raws=jsonld.raw_members(F.col("node")))
            df = pinned(raw, df.columns, **_only(_node_columns(), values))
    if "ingredients" in fields:
        combined = pinned(
            df, [c for c in df.columns if c not in ("events", "payload")], **_event_columns(base)
        )
        combined = combined.withColumn("events", F.col("mentions.events")).withColumn(
            "name_failed", F.col("mentions.failed")
        )
        df = merge_by_name(fold_mentions(combined.drop("mentions")))
    elif "extract_error" in fields:
        df = pinned(df, [c for c in df.columns if c != "payload"], **_failed_column(base))
    return pinned(df, kept, **_only(_product_columns(), fields))


@built_once
def _node_columns() -> dict[str, Column]:
    node = jsonld.Node(F.col("node"), F.col("raws"))
    return {
        "ld_name": node.filled("name"),
        "ld_brand": jsonld.brand(node),
        "ld_description": node.filled("description"),
        "ld_image": jsonld.first_image(node),
        "rating_value": jsonld.rating_value(node),
        "rating_count": jsonld.rating_count(node),
        "count_infinite": jsonld.rating_count_infinite(node),
        "categories": jsonld.categories(node),
        "payload": jsonld.ingredient_payload(node),
        "unread": F.col("json_ld").isNotNull() & F.col("node").isNull(),
    }


@built_once
def _event_columns(base: str) -> dict[str, Column]:
    """JSON mentions come after all anchor events of the page."""
    return {
        "mentions": bind(
            jsonld.json_mentions(F.col("payload"), base),
            lambda mentions: F.struct(
                F.concat(F.col("events"), _json_events(mentions)).cast(f"array<{_EVENT}>").alias("events"),
                F.exists(mentions, lambda m: m["failed"]).alias("failed"),
            ),
        )
    }


@built_once
def _failed_column(base: str) -> dict[str, Column]:
    return {"name_failed": F.exists(jsonld.json_mentions(F.col("payload"), base), lambda m: m["failed"])}


@built_once
def _product_columns() -> dict[str, Column]:
    metas, brands = F.col("metas"), F.col("brands")
    links = F.array_sort(F.array_distinct(F.transform(brands, lambda b: b["url"])))
    named_brand = F.get(F.filter(brands, lambda b: b["text"].isNotNull()), 0)["text"]

    def meta(key: str) -> Column:
        return _last_meta(metas, key)

    return {
        "name": F.coalesce(
            F.col("ld_name"),
            F.col("title"),
            blank_to_null(meta("og:title")),
            meta("twitter:title"),
        ),
        "brand": F.coalesce(
            blank_to_null(F.col("ld_brand")),
            meta("brand:text"),
            named_brand,
            humanize_slug(F.get(links, 0), "brand"),
            F.col("ld_brand"),
        ),
        "description": F.coalesce(
            F.col("ld_description"), blank_to_null(meta("og:description")), meta("description")
        ),
        "image_url": F.coalesce(
            F.col("ld_image"), blank_to_null(meta("og:image")), meta("twitter:image")
        ),
        "rating_value": F.col("rating_value"),
        "rating_count": F.col("rating_count"),
        "categories": F.col("categories"),
        "ingredients": F.col("ingredients"),
        "json_ld": F.col("json_ld"),
        "raw_brand_links": links,
        "extract_error": F.coalesce(
            F.when(F.col("bad_script"), F.lit("script type without a value")),
            F.col("node_error"),
            F.when(F.col("count_infinite"), F.lit(jsonld.COUNT_ERROR)),
            F.when(F.col("name_failed"), F.lit(jsonld.NAME_ERROR)),
            F.when(F.col("unread"), F.lit(jsonld.UNREAD_ERROR)),
        ),
    }


def ingredient_mentions(pages: DataFrame, base: str) -> DataFrame:
    """Mention events of ingredient anchors, as (…, pos, key, kind, name, url)."""
    kept = [c for c in pages.columns if c not in ("url", "html")]
    events = exploded(page_parts(pages, base, parts=("events",)), kept, F.col("events"), "event")
    return events.select(
        *kept,
        "pos",
        "event.key",
        F.when(F.col("event.labelled"), "label").otherwise("text").alias("kind"),
        "event.name",
        "event.url",
    )


def brand_mentions(pages: DataFrame, base: str) -> DataFrame:
    """Brand anchors, as (…, pos, url, text); the text is null when unusable."""
    kept = [c for c in pages.columns if c not in ("url", "html")]
    anchors = exploded(page_parts(pages, base, parts=("brands",)), kept, F.col("brands"), "anchor")
    return anchors.select(*kept, "pos", "anchor.url", "anchor.text")

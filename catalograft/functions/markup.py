"""Markup of a page as an array of marks, built inside the page's own row.

Nothing here moves a page between tasks: tokens, anchors and headings are array
columns next to the page they come from, so extraction needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalograft.functions.stages import bind, built_once, exploded, pinned
from catalograft.functions.text import strip_ws, unescape
from catalograft.functions.urls import has_prefix, strip_fragment

# The inside of a start tag: a quoted value may hold ">", an unclosed one runs to
# the end. Every branch is possessive, so no input makes the match start over.
_INSIDE = (
    r"""(?:[^>"'=]++|=++\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+|["'])*+"""
)
_RAW = rf"<(script|style)(?=[\s/>]){_INSIDE}(?<!/)>(.*?)(</\s*\1\s*>|\z)"
_COMMENT = r"<!--.*?(?:--!?\s*>|\z)"
_SECTION = r"<!\[(?:cdata|rcdata|temp|ignore|include)\b.*?(?:\]\s*\]\s*>|\z)"
_OPAQUE = "|".join(
    rf"<{tag}(?=[\s/>]){_INSIDE}(?<!/)>.*?(?:</\s*{tag}\s*>|\z)" for tag in ("script", "style")
)
_TAG = rf"<[a-z][^\s/>]*+{_INSIDE}(?:>|\z)"
_DECLARATION = r"<[!?/][^>]*+(?:>|\z)"
_REST = rf"{_COMMENT}|{_SECTION}|{_OPAQUE}|{_TAG}|{_DECLARATION}|<"
_TOKEN = rf"(?is)[^<]++|{_REST}"
# an anchor with all that follows up to the next anchor tag, which closes it if it
# is an end tag
_ANCHOR = rf"<a(?=[\s/>]){_INSIDE}>(?:[^<]++|(?!</?\s*a[\s/>])(?:{_REST}))*+(?:</\s*a(?=[\s/>])[^>]*+>)?+"
_ANCHOR_TOKEN = rf"(?is)[^<]++|{_ANCHOR}|{_REST}"
_RAW_TAGS = r"(?is)^<(?:script|style)[^>]*+>|</\s*(?:script|style)\s*>$"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_ANY_ATTRIBUTE = rf"""[^\s/>="'][^\s/>=]*+(?:\s*+=++\s*+{_VALUE}?+)?+"""
_BETWEEN = r"""[\s/"'=]*+"""
_BARE_VALUE_END = r"""=\s*+[^\s"'>][^\s>]*+>$"""
_TYPE_WITHOUT_VALUE = (
    rf"(?is)^<script(?:{_BETWEEN}(?!type[\s/>]){_ANY_ATTRIBUTE})*+{_BETWEEN}type(?=[\s/>])(?!\s*+=)"
)


def _attributes_pattern(*names: str) -> str:
    """A start tag with one group per name; on repeats a group keeps the last value."""
    named = "|".join(rf"{name}\s*+=++\s*+({_VALUE})" for name in names)
    return rf"(?is)^<[a-z][^\s/>]*+(?:{_BETWEEN}(?:{named}|{_ANY_ATTRIBUTE}))*+"


_CUT = "\x01"
_ATTRIBUTES = {
    "a": ("href", "data-name", "title"),
    "meta": ("property", "name", "content"),
    "script": ("type",),
}


def tokens(html: Column) -> Column:
    """All tokens in order: comments, opaque script/style elements, tags, text runs."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))


def anchor_segments(html: Column) -> Column:
    """Every anchor with its content, up to its end tag or the next anchor."""
    pieces = F.regexp_extract_all(html, F.lit(_ANCHOR_TOKEN), F.lit(0))
    return F.filter(pieces, lambda s: s.startswith("<") & s.rlike(r"(?i)^<a[\s/>]") & s.contains(">"))


def segment_closed(pieces: Column) -> Column:
    """Within an anchor segment "</a>" can stand only at the end."""
    last = F.element_at(pieces, -1)
    return last.startswith("</") & last.rlike(r"(?i)^</\s*a[\s/>]")


def self_closed(tag: Column) -> Column:
    return tag.endswith("/>") & ~tag.rlike(_BARE_VALUE_END)


def text_runs(pieces: Column) -> Column:
    """Decoded text among tokens; the body of a script or style element is text too."""
    kept = F.filter(
        pieces,
        lambda t: _is_text(t) | t.rlike(r"(?i)^<(?:script|style)[\s/>]"),
    )
    return F.transform(
        kept,
        lambda t: F.when(_is_text(t), unescape(t)).otherwise(F.regexp_replace(t, _RAW_TAGS, "")),
    )


def explode_tokens(pages: DataFrame) -> DataFrame:
    """One row per token: the page's columns, `pos`, `kind` and `data`."""
    rest = [c for c in pages.columns if c != "html"]
    token = exploded(pages, rest, tokens(F.col("html")), "data")
    data = F.col("data")
    tag = F.lower(F.regexp_extract(data, r"^<(/?\s*[a-zA-Z][^\s/>]*)", 1))
    kind = (
        F.when(_is_text(data), "text")
        .when(data.startswith("<!") | data.startswith("<?") | (tag == ""), "declaration")
        .otherwise(tag)
    )
    return token.select(*rest, "pos", kind.alias("kind"), "data")


def _wanted(tags: Iterable[str], text: bool) -> str:
    names = "|".join(tags)
    runs = r"[^<]|<$|" if text else ""
    raw = "|script|style" if text else ""
    return rf"(?i)^(?:{runs}<(?:{names}{raw})(?=[\s/>])|</\s*(?:{names})(?=[\s/>]))"


def _finished(token: Column) -> Column:
    return (
        ~token.startswith("<")
        | (token == "<")
        | token.endswith(">")
        | token.rlike(r"(?i)^<(?:script|style)[\s/>]")
    )


def decode_value(value: Column) -> Column:
    """An attribute value as written -> its text."""
    quoted = value.startswith('"') | value.startswith("'")
    bare = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    # most values are absent or hold no reference; `bare` is then worked out once at most
    return F.when(value == "", value).when(~value.contains("&"), bare).otherwise(unescape(bare))


def attributes_of(tag: Column, name: str) -> Column:
    """Decoded values of the attributes of interest of one kind of tag, in fixed order:
    a: href, data-name, title; meta: property, name, content; script: type."""
    return F.transform(_raw_attributes(tag, name), decode_value)


def _raw_attributes(tag: Column, name: str) -> Column:
    names = _ATTRIBUTES[name]
    pattern = _attributes_pattern(*names)
    places = range(1, len(names) + 1)
    # one match gives all values, cut at a character the tag does not hold
    values = F.regexp_replace(tag, f"{pattern}.*+$", "".join(f"{_CUT}${i}" for i in places))
    pieces = F.slice(F.split(values, _CUT), F.lit(2), F.lit(len(names)))
    return F.when(tag.contains(_CUT), F.array(*(F.regexp_extract(tag, pattern, i) for i in places))).otherwise(pieces)


def _attribute_values(token: Column, tag: Column) -> Column:
    """Decoded values of the attributes of interest, null where absent."""

    values = F.lit(None).cast("array<string>")
    for name in _ATTRIBUTES:
        values = F.when(tag == name, _raw_attributes(token, name)).otherwise(values)
    return F.transform(values, decode_value)


def _first_filled(*options: Column) -> Column:
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options))


def _is_text(token: Column) -> Column:
    return ~token.startswith("<") | (token == "<")


def _fields(kind: Column, key: Column, value: Column, text: Column, closed: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        key.cast("string").alias("key"),
        value.cast("string").alias("value"),
        text.cast("string").alias("text"),
        closed.alias("closed"),
    )


def _tag_mark(token: Column, kind: Column, values: Column) -> Column:
    first, second, third = (F.get(values, i) for i in range(3))
    # a script "type" without a value is an error on the page: null key
    key = (
        F.when(kind == "a", first)
        .when(kind == "meta", F.lower(strip_ws(F.coalesce(_first_filled(first, second), F.lit("")))))
        .when((kind == "script") & ~token.rlike(_TYPE_WITHOUT_VALUE), F.lower(first))
    )
    value = F.when(kind == "a", _first_filled(second, third)).when(kind == "meta", third)
    raw = kind.isin("script", "style")
    body = F.when(raw, F.regexp_extract(token, rf"(?is)^{_RAW}", 2))
    closed = (
        F.when(raw, F.regexp_extract(token, rf"(?is)^{_RAW}", 3) != "")
        .otherwise(self_closed(token))
    )
    return _fields(kind, key, value, body, closed)


def _mark(token: Column) -> Column:
    tag = F.translate(
        F.lower(F.regexp_extract(token, r"^<(/?\s*[a-zA-Z][a-zA-Z0-9]*)", 1)), " \t\r\n\f", ""
    )
    tagged = bind(
        tag,
        lambda kind: bind(
            _attribute_values(token, kind), lambda values: _tag_mark(token, kind, values)
        ),
    )
    none = F.lit(None)
    run = _fields(F.lit("text"), none, none, unescape(token), F.lit(False))
    return F.when(_is_text(token), run).otherwise(tagged)


@built_once
def tag_marks(tokens_column: str, tags: tuple[str, ...]) -> Column:
    """Marks of the given start tags among a token array."""
    mine = rf"(?i)^<(?:{'|'.join(tags)})[\s/>]"
    found = F.filter(F.col(tokens_column), lambda t: t.startswith("<") & t.rlike(mine) & _finished(t))
    return F.transform(found, _mark)


def page_tokens(html: Column, tags: tuple[str, ...]) -> Column:
    """Text runs, script and style elements and the given tags, in order."""
    wanted = _wanted(tags, True)
    return F.filter(tokens(html), lambda t: ~t.startswith("<") | (t.rlike(wanted) & _finished(t)))


@built_once
def _marks(tags: tuple[str, ...], text: bool) -> Column:
    wanted = _wanted(tags, text)
    kept = F.filter(tokens(F.col("html")), lambda t: t.rlike(wanted) & _finished(t))
    return F.transform(kept, _mark)


def with_marks(pages: DataFrame, tags: Iterable[str], text: bool = True) -> DataFrame:
    """Replace `html` by `marks`: the tags of interest and, if asked, all text runs.

    A mark is (kind, key, value, text, closed); for anchors the key is the href
    and the value the label, for metas they are key and content, for scripts the
    key is the type and the text the body. Script and style elements come with the
    text, because their bodies count as text inside an anchor or heading.
    """
    rest = [c for c in pages.columns if c != "html"]
    return pinned(pages, rest, marks=_marks(tuple(tags), text))


def segments_at(
    df: DataFrame, opens: Callable[[Column], Column], out: str, marks: str = "marks"
) -> DataFrame:
    """Add `out`: the marks from each opening mark up to the next one, in order."""
    at = f"_{out}_at"
    starts = F.transform(F.col(marks), lambda m, i: F.when(opens(m), i))
    df = df.withColumn(at, F.filter(starts, lambda i: i.isNotNull()))
    return df.withColumn(out, _cuts(marks, at)).drop(at)


def closing_position(segment: Column, tag: str) -> Column:
    """1-based place of the mark that closes the segment's element, 0 if none does."""
    return F.array_position(
        F.transform(
            segment,
            lambda m: (m["kind"] == f"/{tag}") | ((m["kind"] == tag) & m["closed"]),
        ),
        F.lit(True),
    ).cast("int")


def runs_before(segment: Column, closing: Column) -> Column:
    """Text runs between the opening mark and the closing position."""
    inner = F.slice(segment, F.lit(2), F.greatest(closing - 2, F.lit(0)))
    return F.transform(
        F.filter(inner, lambda m: m["text"].isNotNull()), lambda m: m["text"]
    )


def is_link(mark: Column, prefixes: Iterable[str]) -> Column:
    return (mark["kind"] == "a") & has_prefix(mark["key"], prefixes)


def link_target(mark: Column) -> Column:
    return strip_fragment(mark["key"])


def first_per_key(df: DataFrame, items: str, key: str, pos: str) -> DataFrame:
    """Keep the first item per key of an array of structs that lead with (key, pos).

    Sorting brings equal keys together, so this stays n log n on any page.
    """
    ordered = f"_{items}_sorted"
    df = df.withColumn(ordered, F.sort_array(items))
    kept = F.filter(
        F.col(ordered),
        lambda x, i: (i == 0) | (x[key] != F.get(F.col(ordered), i - 1)[key]),
    )
    by_position = F.transform(
        F.sort_array(F.transform(kept, lambda x: F.struct(x[pos].alias("at"), x.alias("item")))),
        lambda x: x["item"],
    )
    return df.withColumn(items, by_position).drop(ordered)


def group_runs(df: DataFrame, items: str, key: str, out: str) -> DataFrame:
    """Add `out`: the items sorted and cut into one array per key.

    Items are structs that lead with the key and then their order, so every group
    comes out in item order.
    """
    ordered, at = f"_{out}_sorted", f"_{out}_at"
    df = df.withColumn(ordered, F.sort_array(items))
    df = df.withColumn(at, _run_starts(ordered, key))
    return df.withColumn(out, _cuts(ordered, at)).drop(ordered, at)


@built_once
def _run_starts(ordered: str, key: str) -> Column:
    starts = F.transform(
        F.col(ordered),
        lambda x, i: F.when((i == 0) | (x[key] != F.get(F.col(ordered), i - 1)[key]), i),
    )
    return F.filter(starts, lambda i: i.isNotNull())


@built_once
def _cuts(items: str, at: str) -> Column:
    """Slices of an array from each start position up to the next one."""
    every = F.col(items)
    return F.transform(
        F.col(at),
        lambda start, k: F.slice(
            every, start + 1, F.coalesce(F.get(F.col(at), k + 1), F.size(every)) - start
        ),
    )

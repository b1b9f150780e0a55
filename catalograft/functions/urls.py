"""Address and slug functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalograft.functions.text import strip_ws, title_case

_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"
# a path without dots, colons, queries, fragments or empty segments
_PLAIN_PATH = r"^/*+(?:[\w~+-]++/?+)*+$"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"


def site_root(base: str) -> str:
    return base.rstrip("/")


def _resolve_dots(path: Column) -> Column:
    """Remove "." and ".." segments of a root-relative path without leading slash."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    ends_in_dots = F.element_at(segments, -1).isin(".", "..") & (joined != "")
    return F.when(ends_in_dots, F.concat(joined, F.lit("/"))).otherwise(joined)


def root_join(c: Column, base: str) -> Column:
    """Address of a reference against the site root.

    Leading slashes are dropped first, so "//host/x" becomes "<base>/host/x"; a
    reference that has a scheme of its own stays as it is.
    """
    bare = F.translate(F.ltrim(c, F.lit("/")), "\t\r\n", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^?#]*", 0), "/{2,}", "/")
    tail = F.regexp_extract(bare, r"(?s)[?#].*$", 0)
    resolved = F.when(path.rlike(_DOT_SEGMENT), _resolve_dots(path)).otherwise(path)
    root = F.lit(site_root(base) + "/")
    return (
        F.when(c.rlike(_PLAIN_PATH), F.concat(root, F.ltrim(c, F.lit("/"))))
        .when(bare.rlike(_SCHEME), bare)
        .otherwise(F.concat(root, resolved, tail))
    )


def build_url(c: Column, base: str) -> Column:
    """Absolute address: http(s) addresses unchanged, anything else joined to the root."""
    absolute = c.startswith("http://") | c.startswith("https://")
    return F.when(absolute, c).otherwise(root_join(c, base))


def before_query(c: Column) -> Column:
    """An address without its query and fragment."""
    return F.regexp_extract(c, "^[^?#]*", 0)


def query_join(current: Column, ref: Column) -> Column:
    """Address of a "?query" reference found on the page `current`."""
    return F.concat(before_query(current), ref)


def strip_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def has_prefix(c: Column, prefixes) -> Column:
    """True when `c` is non-empty and starts with one of the prefixes."""
    hit = reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes))
    return F.coalesce((c != "") & hit, F.lit(False))


def humanize_slug(c: Column, variant: str = "link") -> Column:
    """Readable name from the last path segment.

    `link` drops trailing slashes and trims; `brand` drops trailing slashes only;
    `mention` does neither, so an address ending in "/" gives "".
    """
    source = c if variant == "mention" else F.rtrim(c, F.lit("/"))
    slug = F.translate(F.substring_index(source, "/", -1), "-", " ")
    return title_case(strip_ws(slug) if variant == "link" else slug)


def letter_url(token: Column, page: Column, base: str) -> Column:
    """Address of a letter listing; the page number appears only above 1."""
    suffix = F.when(page > 1, F.concat(F.lit("&page="), page.cast("string"))).otherwise("")
    return F.concat(
        F.lit(site_root(base) + "/brands?letter="), F.url_encode(token), suffix
    )


def mention_key(url: Column, name: Column) -> Column:
    """Identity of an ingredient mention: its address, else its name, ignoring case."""
    return (
        F.when(F.coalesce(url, F.lit("")) != "", F.lower(url))
        .when(F.coalesce(name, F.lit("")) != "", F.lower(strip_ws(name)))
        .otherwise(F.lit(""))
    )

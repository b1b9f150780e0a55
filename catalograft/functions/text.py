"""Text clean-up as Column expressions; everything here stays in the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace that str.strip() removes.
_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_CASE_RUNS = rf"[{_CASED}]+|[^{_CASED}]+"

# The forms of a character reference.
_REFERENCE_PIECES = (
    r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
)
# References that plain replacement decodes; "&amp;" has to go last.
_PLAIN_REFERENCES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&amp;": "&",
}
_NOT_PLAIN = "&(?!(?:lt|gt|quot|#39|apos|nbsp|amp);)"

_PAIR, _ENTRY = "\x02", "\x01"


def strip_ws(c: Column) -> Column:
    """Trim Unicode whitespace from both ends, as str.strip() does."""
    return F.btrim(c, F.lit(_WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(c, F.lit(""))


def join_runs(runs: Column) -> Column:
    """Trim each text run, drop empty ones, join the rest with one space."""
    return F.array_join(F.filter(F.transform(runs, strip_ws), lambda r: r != ""), " ")


def title_case(c: Column) -> Column:
    """Capitalise every run of cased letters ("3ce" -> "3Ce", "l'oreal" -> "L'Oreal")."""
    return F.array_join(
        F.transform(F.regexp_extract_all(c, F.lit(_CASE_RUNS), F.lit(0)), F.initcap), ""
    )


def split_list(c: Column) -> Column:
    """Comma-separated text -> trimmed, non-empty parts in order."""
    return F.filter(F.transform(F.split(c, ","), strip_ws), lambda part: part != "")


def _named_references() -> Column:
    table = _ENTRY.join(f"{name}{_PAIR}{text}" for name, text in html5.items())
    return F.str_to_map(F.lit(table), F.lit(_ENTRY), F.lit(_PAIR))


def _legacy_prefix() -> str:
    names = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return f"^(?:{'|'.join(names)})"


def _windows_1252() -> str:
    """Numeric references 128..159 mean the Windows-1252 characters."""
    return "".join(
        bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)
    )


def _from_code_point(n: Column) -> Column:
    plane_end = n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE
    dropped = (
        n.between(0x1, 0x8)
        | (n == 0xB)
        | n.between(0xE, 0x1F)
        | (n == 0x7F)
        | n.between(0xFDD0, 0xFDEF)
        | plane_end
    )
    return (
        F.when(n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("�"))
        .when(n.between(0x80, 0x9F), F.substr(F.lit(_windows_1252()), (n - 0x7F).cast("int"), F.lit(1)))
        .when(dropped, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _decode_reference(piece: Column) -> Column:
    hexa = F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]{1,7});?$", 1)
    decimal = F.regexp_extract(piece, "^&#0*([0-9]{1,9});?$", 1)
    zero = piece.rlike("^&#[xX]?0+;?$")
    name = F.substring(piece, 2, 40)
    prefix = F.regexp_extract(name, _legacy_prefix(), 0)
    references = _named_references()
    return (
        F.when(~piece.startswith("&") | (piece == "&"), piece)
        .when(zero, F.lit("�"))
        .when(
            piece.rlike("^&#[xX]"),
            _from_code_point(F.conv(blank_to_null(hexa), 16, 10).cast("bigint")),
        )
        .when(piece.startswith("&#"), _from_code_point(blank_to_null(decimal).cast("bigint")))
        .otherwise(
            F.coalesce(
                F.try_element_at(references, name),
                F.concat(
                    F.try_element_at(references, blank_to_null(prefix)),
                    F.substr(name, F.length(prefix) + 1),
                ),
                piece,
            )
        )
    )


def unescape(c: Column) -> Column:
    """Decode HTML character references.

    Text without "&" is returned as it is; text holding only the common
    references goes through plain replacement; the rest is cut into pieces.
    """
    plain = c
    for reference, char in _PLAIN_REFERENCES.items():
        plain = F.replace(plain, F.lit(reference), F.lit(char))
    pieces = F.regexp_extract_all(c, F.lit(_REFERENCE_PIECES), F.lit(0))
    return (
        F.when(~c.contains("&"), c)
        .when(~c.rlike(_NOT_PLAIN), plain)
        .otherwise(F.array_join(F.transform(pieces, _decode_reference), ""))
    )

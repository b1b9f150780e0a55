"""License templates found by MinHash bands over text windows, with built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalograft.functions.stages import bind, pinned
from catalograft.llm.common import ascii_lower

#: A word of a notice: letters and digits, dots only inside a version.
NOTICE_WORD = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"
SHINGLE = 5
LEAST_CONTAINMENT = 0.8
#: Most entries of a template index that is broadcast at once. An entry is one shingle of one
#: template, about 100 bytes, so a part stays near 10 MB.
MOST_ENTRIES = 100_000

#: Public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license_id string, text string")


def _shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text in order."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit(NOTICE_WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        one = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, one).otherwise(F.array().cast("array<bigint>"))

    return bind(words, hashes)


def bands_for(least_shingles: int, width: int = 4, miss: float = 0.01) -> int:
    """Bands so that a window that holds `least_shingles` of a template misses it with
    probability at most `miss`. A band is one minimum or one maximum."""
    share = min(least_shingles, width) / width
    return 1 if share == 1 else math.ceil(math.log(miss) / math.log(1 - share))


def _bands_of(held: int, width: int) -> int:
    """Bands for windows of `width` when a text holds at least `held` shingles of a template.

    However the held shingles lie in the windows, a band misses them all with probability
    at most (width - 1) / (width - 1 + held): each misses only if one of the width - 1 others
    of its window comes first, and that is likeliest when all windows share those others.
    The least and the greatest of one order are no worse than independent bands, as a miss of
    the one grows likelier with the hashes held and a miss of the other less likely. In
    windows of two they are the whole window.
    """
    return 2 if width == 2 else bands_for(held, held + width - 1)


def _turned(hashes: Column, bits: int) -> Column:
    """The hashes with their bits turned round, another order of the same shingles."""
    if not bits:
        return hashes
    return F.transform(hashes, lambda h: F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)))


def _end_of(end: Callable[[Column], Column], hashes: Column, width: int, start: Column) -> Column:
    return end(F.slice(hashes, start, F.lit(width)))


def _minima(hashes: Column, bands: int, width: int) -> Column:
    """The distinct shingles that come first in a window of a text in the order of a band.

    The orders are those of the hash and, backwards, of its maxima, and the same of its turned
    bits. A band's shingle is read off its hash, so windows need no hashing.
    """
    step = width // 2
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - width + step, F.lit(1)), F.lit(step))
    orders = -(-bands // 2)
    found = []
    for order in range(orders):
        bits = 64 // orders * order

        ends = [F.array_min, F.array_max][: bands - 2 * order]

        def firsts(turned: Column) -> Column:
            return F.concat(*(F.transform(starts, partial(_end_of, end, turned, width)) for end in ends))

        one = bind(_turned(hashes, bits), firsts)
        found.append(_turned(one, 64 - bits) if bits else one)
    return F.array_distinct(F.concat(*found))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """(doc_id, license_id, containment) for each text and each template it holds.

    In: doc_id, text; templates license_id, text (other columns are ignored). Templates are
    classed by length: those of which a text must hold m shingles are sought with windows of
    about m / 4 shingles (two at least) that overlap by half. The bands of each window retrieve
    templates of its class; their number follows from the shortest of the class, so that one a
    text holds is missed with probability at most 0.01 wherever its shingles lie, and of a long
    template only a few dozen shingles are met however long it is. A retrieved template is
    verified: at least `least` of its distinct shingles must occur in the text.

    The index holds each shingle once with the numbers of its templates, the templates' shingles
    stand beside it; both are broadcast in parts of about MOST_ENTRIES entries. Templates that
    have more shingles than that are joined without a broadcast; only texts of that length are
    asked about them. Otherwise texts are never shuffled.

    Null or short texts (under five words): no row. Templates under five words or null ones:
    never found. Repeated rows: the same row again. Templates with equal ids are different
    templates. No rows or no templates: no rows.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    shingled = pinned(templates.select("license_id", "text"), ["license_id"], shingles=F.array_distinct(_shingles(F.coalesce("text", F.lit("")))))
    held = F.greatest(F.ceil(F.size("shingles") * F.lit(float(least)) - 1e-9), F.lit(1)).cast("int")
    shingled = shingled.where("size(shingles) > 0").select(
        "license_id",
        "shingles",
        F.xxhash64("license_id", "shingles").alias("template"),
        held.alias("held"),
        (F.size("shingles") > MOST_ENTRIES).alias("large"),
        F.when(held < 16, 2).otherwise(F.pow(F.lit(2), F.floor(F.log2(held / 4)))).cast("int").alias("width"),
    )
    # at most some thirty widths, each with and without large templates
    classes = shingled.groupBy("large", "width").agg(F.min("held"), F.sum(F.size("shingles"))).collect()
    text = pinned(docs.select("doc_id", "text"), ["doc_id"], hashes=_shingles(F.coalesce("text", F.lit(""))))
    if not classes:
        return text.select("doc_id", F.lit(None).cast("string").alias("license_id"), F.lit(0.0).alias("containment")).limit(0)
    found = []
    for large in sorted({c[0] for c in classes}):
        some = shingled.where("large" if large else "not large").drop("large")
        widths = sorted((width, shortest) for l, width, shortest, _ in classes if l == large)
        parts = 1 if large else -(-sum(c[3] for c in classes if c[0] == large) // MOST_ENTRIES)
        for part in range(parts):
            one = some if parts == 1 else some.where(F.pmod("template", F.lit(parts)) == part)
            found.append(_matches(text, one, widths, least, not large))
    return reduce(DataFrame.union, found)


def _matches(text: DataFrame, templates: DataFrame, widths: list[tuple[int, int]], least: float, small: bool) -> DataFrame:
    """Rows of the texts that hold templates; `widths` are the windows, each with the fewest shingles to be held."""

    def sent(df: DataFrame) -> DataFrame:
        # small ones have some MOST_ENTRIES entries, counted above
        return F.broadcast(df) if small else df.hint("merge")

    templates = templates.dropDuplicates(["template"])
    # the key of a probe is the shingle's hash with the window's width, so that classes stay apart
    entries = templates.select("template", F.explode("shingles").alias("h"), "width")
    index = entries.groupBy(F.col("h").bitwiseXOR(F.col("width").cast("long")).alias("key")).agg(F.collect_list("template").alias("templates"))
    none = F.array().cast("array<bigint>")

    def probes(hashes: Column) -> Column:
        def of(width: int, shortest: int) -> Column:
            keys = F.transform(_minima(hashes, _bands_of(shortest, width), width), lambda h: h.bitwiseXOR(F.lit(width).cast("long")))
            return F.when(F.size(hashes) >= shortest, keys).otherwise(none)

        return F.concat(*(of(*w) for w in widths))

    asked = pinned(text.where(F.size("hashes") >= min(s for _, s in widths)), ["doc_id", "hashes"], probes=probes(F.col("hashes")))
    met = asked.select("*", F.explode("probes").alias("m")).join(sent(index), F.col("m") == F.col("key"))
    met = met.select("doc_id", "hashes", "probes", "m", F.explode("templates").alias("number"))
    met = met.join(sent(templates), F.col("number") == F.col("template"))
    # several shingles of a template meet: the first of them among the text's speaks for it
    keys = F.transform("shingles", lambda h: h.bitwiseXOR(F.col("width").cast("long")))
    first = F.array_intersect(keys, "probes")[0] == F.col("m")
    inside = F.size(F.array_intersect("shingles", "hashes")) / F.size("shingles")
    verified = met.where(first).select("doc_id", "license_id", inside.alias("containment"))
    return verified.where(F.col("containment") >= least)

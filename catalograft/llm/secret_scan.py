"""Multipart credential linking with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalograft.functions.stages import pinned
from catalograft.llm.common import set_aside
from catalograft.session import settle

#: Patterns of the certain kinds, with the least length of what is kept and its group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Parts that mean nothing alone: who logs in, where, and a key-like word without a name.
#: A host name has at most 253 characters, which also bounds a search that fails.
IDENTITY = r"(?i:(?:\b|(?<=_))(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@=-]+"
ENDPOINT = r"(?i:\b(?:https?|ftp|ssh|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+|\b[a-z0-9.-]{1,253}\.amazonaws\.com\b)"
KEYLIKE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])"
#: Order of the kinds in results.
KINDS = ("assign", "access", "hex", "identity", "endpoint", "keylike")
#: While parts are linked: a key-like word right after '=', which may stand in an endpoint's query.
VALUE = len(KINDS)
#: Parts link when at most so many characters lie between them.
SCOPE = 200


def _matches(text: str, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Array of (start, stop, kind) of the leftmost matches, by code points.

    The texts between matches and the matches alternate, so the sums of their lengths are
    the places.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)

    def spans(pair: Column) -> Column:
        gaps, hits = pair["gaps"], pair["hits"]
        begin = F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:boolean>>").alias("spans")
        )

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gaps"])
            stop = start + F.length(x["hits"])
            value = F.endswith(x["gaps"], F.lit("="))
            one = F.struct(start.alias("start"), stop.alias("stop"), value.alias("value"))
            return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

        zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gaps"), hits.alias("hits"))
        return F.when(F.size(hits) == 0, begin["spans"]).otherwise(
            F.aggregate(zipped, begin, step, lambda acc: acc["spans"])
        )

    # most texts have no match: one search decides
    pair = F.struct(between.alias("gaps"), found.alias("hits"))
    all_spans = F.transform(F.array(pair), spans)[0]
    if keep is not None:
        good = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= 6)
        both = F.arrays_zip(all_spans.alias("span"), good.alias("good"))
        all_spans = F.transform(F.filter(both, lambda x: x["good"]), lambda x: x["span"])
    number = F.lit(KINDS.index(kind))

    def name(s: Column) -> Column:
        of = F.when(s["value"], F.lit(VALUE)).otherwise(number) if kind == "keylike" else number
        return F.struct(s["start"].alias("start"), of.alias("kind"), s["stop"].alias("stop"))

    named = F.transform(all_spans, name)
    return F.when(F.col(text).rlike(pattern), named).otherwise(
        F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    )


def _listing(spans: Column) -> Column:
    """kind:start:stop by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All rows of `docs` (every column) plus base and linked secret spans.

    Adds `secret_base` and `secret_linked`: arrays of (start, kind, stop), kind an index
    into KINDS, code points, stop exclusive. Certain kinds (assign, access, hex) are always
    reported. A weak part (a key-like word, an identity or an endpoint) is reported only when
    complementary parts lie within `scope` characters: a key-like word with an identifier
    (access or identity) or an endpoint, an identity or endpoint with a secret (assign, hex or
    a key-like word). Parts must not overlap, but a value in an endpoint's own query counts.
    Parts are joined as intervals: each is put in every bucket of `scope`
    characters its reach touches, so a text with very many parts is split over buckets.

    Null text: no spans. Empty table: no rows. Repeated rows (also of a null doc_id) are the
    same text and get the same spans. Other columns may have any name and type; those named
    like the results give way to them.
    """
    docs, named = set_aside(docs.drop("secret_base", "secret_linked"), "doc_id", "text")
    kept = docs.columns
    text = F.coalesce(docs["text"], F.lit(""))
    staged = docs.select(*(docs[c] for c in kept), text.alias("__scanned"))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    parts = {
        "__base": F.concat(
            _matches("__scanned", ASSIGN, "assign", F.lit(True)),
            _matches("__scanned", ACCESS, "access"),
            _matches("__scanned", HEX, "hex"),
        ),
        "__weak": F.concat(
            _matches("__scanned", IDENTITY, "identity"),
            _matches("__scanned", ENDPOINT, "endpoint"),
            _matches("__scanned", KEYLIKE, "keylike"),
        ),
    }
    key = F.md5("__scanned")
    # a row without weak parts joins nothing; a key of its own spreads such rows
    alone = F.concat(F.lit("-"), F.xxhash64("doc_id", "text").cast("string"))
    keyed = F.when(F.size("__weak") > 0, key).otherwise(alone)
    found = pinned(staged, [*kept, "__scanned"], **parts).withColumn("__key", keyed)
    weak = settle(
        found.where("size(__weak) > 0")
        .select("__key", F.concat("__base", "__weak").alias("part"))
        .groupBy("__key")
        .agg(F.first("part").alias("part"))
        .select("__key", F.explode("part").alias("p"))
        .select("__key", "p.start", "p.kind", "p.stop")
    )
    linked = _linked(weak, scope).groupBy("__key").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("__linked"))
    joined = found.join(linked.withColumnRenamed("__key", "__k"), F.col("__key") == F.col("__k"), "left")
    return named(
        joined.select(
            *kept,
            F.array_sort("__base").alias("secret_base"),
            F.coalesce(F.array_sort("__linked"), empty).alias("secret_linked"),
        )
    )


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts with a complementary part within the scope."""
    access, hexes, assign = KINDS.index("access"), KINDS.index("hex"), KINDS.index("assign")
    identity, endpoint, keylike = map(KINDS.index, ("identity", "endpoint", "keylike"))
    reach = F.expr(f"explode(sequence((start - {scope}) div {scope} - 1, (stop + {scope}) div {scope} + 1))")
    left = parts.where(F.col("kind").isin(identity, endpoint, keylike, VALUE)).select("*", reach.alias("bucket"))
    right = (
        parts.select(
            F.col("__key").alias("k"), F.col("start").alias("s"), F.col("stop").alias("e"),
            F.col("kind").alias("other"),
            F.explode(F.expr(f"sequence(start div {scope}, stop div {scope})")).alias("at"),
        )
    )
    fits = (
        F.col("kind").isin(keylike, VALUE) & F.col("other").isin(access, identity, endpoint)
    ) | (F.col("kind").isin(identity, endpoint) & F.col("other").isin(assign, hexes, keylike, VALUE))
    near = (F.col("s") <= F.col("stop") + scope) & (F.col("e") >= F.col("start") - scope)
    same = (F.col("__key") == F.col("k")) & (F.col("bucket") == F.col("at"))
    apart = (F.col("e") <= F.col("start")) | (F.col("s") >= F.col("stop"))
    # apart fails only for parts that overlap: then the value lies in the endpoint
    query = ((F.col("kind") == VALUE) & (F.col("other") == endpoint)) | ((F.col("kind") == endpoint) & (F.col("other") == VALUE))
    kind = F.when(F.col("kind") == VALUE, keylike).otherwise(F.col("kind")).alias("kind")
    # semi join: no row per pair
    return left.join(right, same & fits & near & (apart | query), "left_semi").select("__key", "start", kind, "stop").distinct()


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and listings of the spans per row."""
    base, linked = F.col("secret_base"), F.col("secret_linked")

    def count(kind: str) -> Column:
        number = KINDS.index(kind)
        return F.size(F.filter(base, lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listing(base), 256).alias("base_sha256"),
        _listing(F.concat(base, linked)).alias("spans"),
    )


def redact(scanned: DataFrame) -> DataFrame:
    """The rows with every reported span of the text replaced by its kind in brackets."""
    spans = F.array_sort(F.concat("secret_base", "secret_linked"))
    names = F.array(*map(F.lit, KINDS))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
        overlaps = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(overlaps, acc["out"]).otherwise(F.concat(acc["out"], gap, mark)).alias("out"),
        )

    rest = F.aggregate(
        spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    )
    clean = F.when(F.size(spans) == 0, F.col("text")).otherwise(rest)
    return scanned.withColumn("text", clean).drop("secret_base", "secret_linked")

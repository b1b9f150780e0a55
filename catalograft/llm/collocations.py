"""Collocations: frequent phrases of a corpus, mined by an FM-index per shard over word ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalograft.llm.common import LOWER, mix64
from catalograft.session import checkpoint_dir, settle

UNKNOWN = "und"
#: Words of the longest phrase; least occurrences of a phrase; phrases returned per language.
LONGEST, LEAST_COUNT, TOP = 5, 100, 2000
#: A phrase goes when a longer one around it has so many percent of its occurrences.
ABSORBED = 100
#: Words after which a shard is full; a shard never cuts a document.
SHARD_WORDS = 1 << 21
#: Text is read in blocks of about so many bytes.
_BLOCK = 1 << 22
#: Bytes that end a piece become a line feed, the space between words a blank.
_ENDS = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else LOWER[b] for b in range(256))

#: Words or grown phrases that meet in one bucket, about.
BUCKET_ROWS = 1 << 20

_SHARD = "shard string, lang string, words array<string>, counts array<long>, data binary"
_INDEX = "shard string, lang string, codes binary, before binary, after binary"
#: What travels between shards and buckets: kind `ask` to a bucket, `told` and `state` to a shard, `model` stays.
_MAIL = (
    "kind string, lang string, bucket long, shard string, data array<binary>, "
    "ids array<long>, words array<string>, prefix array<long>, suffix array<long>, f array<long>"
)
_MAIL_KINDS = {
    **dict.fromkeys(("kind", "lang", "shard"), pa.string()), "bucket": pa.int64(), "data": pa.list_(pa.binary()),
    "words": pa.list_(pa.string()), **dict.fromkeys(("ids", "prefix", "suffix", "f"), pa.list_(pa.int64())),
}
_MAIL_ORDER = [c.split()[0] for c in _MAIL.split(", ")]


class _Shard:
    """Words of one language as ids of a vocabulary of the shard's own; 0 ends a piece."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.blocks: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        # a blank line feed on its own stands for the end of a piece
        found = b"\n".join([*texts, b""]).translate(_ENDS).replace(b"\n", b" \n ").split(b" ")
        found = [w for w in found if w]
        self.ids.setdefault(b"\n", 0)
        for word in set(found):
            self.ids.setdefault(word, len(self.ids))
        block = np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found))
        # ends after ends say nothing
        block = block[(block > 0) | np.concatenate([[True], block[:-1] > 0])]
        self.blocks.append(block)
        self.size += block.size

    def row(self, lang: str) -> pa.RecordBatch:
        data = np.concatenate(self.blocks).astype("<i4")
        counts = np.bincount(data, minlength=len(self.ids))[1:]
        words = [w.decode("utf-8", "replace") for w in self.ids][1:]
        columns = [[uuid.uuid4().hex], [lang], [words], [counts], [data.tobytes()]]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "lang", "words", "counts", "data"]
        )


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task to shards of one language each."""
    open_shards: dict[str, _Shard] = {}
    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        held = 0
        for i in range(batch.num_rows):
            lang, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
            waiting.setdefault(lang, []).append(text)
            held += len(text)
            if held >= _BLOCK or i + 1 == batch.num_rows:
                for name, texts in waiting.items():
                    shard = open_shards.setdefault(name, _Shard())
                    shard.add(texts)
                    if shard.size >= SHARD_WORDS:
                        yield open_shards.pop(name).row(name)
                waiting, held = {}, 0
    for name, shard in open_shards.items():
        yield shard.row(name)


def bounded_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first `depth` symbols; what follows a 0 does not count.

    By doubling: ranks of 1, 2, 4, … symbols give those of twice as many.
    """

    def later(ranks: np.ndarray, by: int, over: np.ndarray) -> np.ndarray:
        moved = np.concatenate([ranks[by:], np.zeros(min(by, ranks.size), ranks.dtype)])
        return np.where(over, 0, moved)

    def dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        step = np.ones(key.size, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        ranks = np.empty(key.size, np.int64)
        ranks[order] = np.cumsum(step)
        return ranks, order

    over = text == 0  # a 0 among the symbols ranked so far
    ranks, order = dense(text.astype(np.int64))
    known = 1
    while known < depth:
        step = min(known, depth - known)
        # overlapping windows rank as well as adjacent ones
        key = ranks * (ranks.max() + 1) + later(ranks, step, over)
        over = over | later(over, step, over).astype(bool)
        ranks, order = dense(key)
        known += step
    return order


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each position, positions ordered by their first `depth` symbols: a
    Burrows-Wheeler transform in which patterns of up to `depth` symbols have an interval."""
    order = bounded_order(text, depth)
    return np.where(order > 0, text[order - 1], 0).astype(np.int64)


def _mail(rows: list[dict]) -> pa.Table:
    return pa.table({c: pa.array([r.get(c) for r in rows], _MAIL_KINDS[c]) for c in _MAIL_ORDER})


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes each; the first byte says how many."""
    top = int(values.max()) if values.size else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Transform:
    """A transform with what answers rank queries: its rows in the order of symbol, then row."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt.astype(np.int64)
        narrow = bwt.astype(np.uint16) if bwt.size and bwt.max() < 1 << 16 else bwt  # sorted by radix
        self.order = np.argsort(narrow, kind="stable")
        self.keys = self.bwt[self.order] * (bwt.size + 1) + self.order

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows that begin with a smaller symbol, and symbols of this kind before `row`."""
        return np.searchsorted(self.keys, symbol * (self.bwt.size + 1) + row)

    def moved(self) -> np.ndarray:
        """By row: the row of the suffix that is one symbol longer."""
        out = np.empty(self.order.size, np.int64)
        out[self.order] = np.arange(self.order.size)
        return out


@dataclass
class Phrases:
    """Phrases of a shard that are frequent over all shards, by ascending id: their intervals in the
    index of the text and in that of the reversed text, occurrences, first and last symbol."""

    ids: np.ndarray
    text: np.ndarray
    reverse: np.ndarray
    size: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def words(cls, codes: np.ndarray, bwt: np.ndarray) -> Phrases:
        counts = np.bincount(bwt, minlength=codes.size + 1)
        start = (np.cumsum(counts) - counts)[1:]
        symbols = np.arange(1, codes.size + 1)
        return cls(codes.astype(np.int64), start, start, counts[1:], symbols, symbols)

    def columns(self) -> list[np.ndarray]:
        return [self.ids, self.text, self.reverse, self.size, self.first, self.last]

    def joined(self, before: Transform, after: Transform, prefix: np.ndarray, suffix: np.ndarray, ids: np.ndarray) -> Phrases:
        """The phrases one word longer with these prefixes and suffixes: a step of backward search in each index."""
        p, s = np.searchsorted(self.ids, prefix), np.searchsorted(self.ids, suffix)
        first, last = self.first[p], self.last[s]
        reverse = after.step(last, self.reverse[p])
        size = after.step(last, self.reverse[p] + self.size[p]) - reverse
        order = np.argsort(ids)
        grown = (ids, before.step(first, self.text[s]), reverse, size, first, last)
        return Phrases(*(v[order] for v in grown))


def extend(index: Transform, here: np.ndarray, there: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """All extensions of intervals by the symbol the transform holds: (parent, other, here, there, n).

    `here` are the starts in this index (the text's extends to the left, the reversed
    text's to the right), `there` those in the other index, which stay in step: within an
    interval the extensions lie in the order of their symbols. `other` is the interval an extension
    falls into when its far end is cut off, -1 if that is none of those given.
    """
    if not size.size:
        return (np.zeros(0, np.int64),) * 5
    bwt = index.bwt
    begin = np.cumsum(size) - size
    parent = np.repeat(np.arange(size.size), size)
    rows = np.arange(parent.size) + np.repeat(here - begin, size)
    key = parent * (int(bwt.max()) + 1) + bwt[rows]
    order = np.argsort(key)
    at = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
    n = np.diff(np.concatenate([at, [key.size]]))
    first = np.minimum.reduceat(rows[order], at)
    up = parent[order[at]]
    beside = there[up] + at - begin[up]
    owner = np.full(bwt.size, -1, np.int64)
    owner[rows] = parent
    on = bwt[first] > 0
    start = index.moved()[first[on]]
    return up[on], owner[start], start, beside[on], n[on]


def grown(before: Transform, after: Transform, known: Phrases, to_the_right: bool) -> tuple[np.ndarray, ...]:
    """(prefix, suffix, n) of all phrases one word longer both of whose parts are known."""
    if to_the_right:
        up, other, *_, n = extend(after, known.reverse, known.text, known.size)
        prefix, suffix = up, other
    else:
        up, other, *_, n = extend(before, known.text, known.reverse, known.size)
        prefix, suffix = other, up
    on = other >= 0
    return known.ids[prefix[on]], known.ids[suffix[on]], n[on]


def _asks(lang: str, shard: str, prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[dict]:
    """Grown phrases to the buckets that sum them over all shards."""
    home = (mix64(prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + suffix.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((suffix, prefix, home))
    home, prefix, suffix, n = (v[order] for v in (home, prefix, suffix, n))
    found, at = np.unique(home, return_index=True)
    for bucket, s, e in zip(found.tolist(), at, np.append(at, home.size)[1:], strict=True):
        data = [_packed(np.diff(prefix[s:e], prepend=0)), _packed(suffix[s:e]), _packed(n[s:e])]
        yield {"kind": "ask", "lang": lang, "bucket": bucket, "shard": shard, "data": data}


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                by_bucket: dict[int, list[int]] = {}
                words = [w.encode() for w in row["words"]]
                for i, word in enumerate(words):
                    by_bucket.setdefault(zlib.crc32(word) % buckets, []).append(i)
                counts = np.array(row["counts"], np.int64)
                rows = [
                    {"kind": "ask", "lang": row["lang"], "bucket": b, "shard": row["shard"],
                     "data": [b"\n".join(words[i] for i in at), _packed(counts[at]), _packed(np.array(at) + 1)]}
                    for b, at in by_bucket.items()
                ]
                yield from _mail(rows).to_batches()

    return ask


def _count_words(buckets: int, least: int):
    def count(asked: pa.Table) -> pa.Table:
        rows = asked.select(["lang", "bucket", "shard", "data"]).to_pylist()
        lang, bucket = rows[0]["lang"], rows[0]["bucket"]
        ids: dict[bytes, int] = {}
        codes = []
        for r in rows:
            words = r["data"][0].split(b"\n")
            for word in words:
                ids.setdefault(word, len(ids))
            codes.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        total = np.zeros(len(ids), np.int64)
        for r, code in zip(rows, codes, strict=True):
            total[code] += _unpacked(r["data"][1])
        names = [w.decode() for w in ids]
        # numbers of their own in every bucket
        number = np.where(total >= least, (np.cumsum(total >= least) - 1) * buckets + bucket, -1)
        kept = np.flatnonzero(number >= 0)
        out = [{"kind": "model", "lang": lang, "ids": number[kept], "words": [names[i] for i in kept], "f": total[kept]}]
        for r, code in zip(rows, codes, strict=True):
            on = number[code] >= 0
            if on.any():
                out.append({"kind": "told", "shard": r["shard"], "data": [_packed(_unpacked(r["data"][2])[on]), _packed(number[code][on])]})
        return _mail(out)

    return count


def _count_phrases(buckets: int, least: int):
    def count(asked: pa.Table) -> pa.Table:
        rows = asked.select(["lang", "bucket", "shard", "data"]).to_pylist()
        lang, bucket = rows[0]["lang"], rows[0]["bucket"]
        parts = [[_unpacked(d) for d in r["data"]] for r in rows]
        prefix = np.concatenate([np.cumsum(p[0]) for p in parts])
        suffix = np.concatenate([p[1] for p in parts])
        n = np.concatenate([p[2] for p in parts])
        wide = int(suffix.max()) + 1
        if (int(prefix.max()) + 1) * wide < 1 << 63:
            key = prefix * wide + suffix
        else:
            firsts, code = np.unique(prefix, return_inverse=True)
            lasts, other = np.unique(suffix, return_inverse=True)
            key = code * lasts.size + other
        _, at, code = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(at.size, np.int64)
        np.add.at(total, code, n)
        number = np.where(total >= least, (np.cumsum(total >= least) - 1) * buckets + bucket, -1)
        kept = np.flatnonzero(number >= 0)
        model = {"ids": number[kept], "prefix": prefix[at[kept]], "suffix": suffix[at[kept]], "f": total[kept]}
        out = [{"kind": "model", "lang": lang, **model}] if kept.size else []
        told, begin = number[code], 0
        for r, p in zip(rows, parts, strict=True):
            here = np.arange(begin, begin + p[0].size)
            here = here[told[here] >= 0]
            begin += p[0].size
            if here.size:
                out.append({"kind": "told", "shard": r["shard"], "data": [_packed(v[here]) for v in (prefix, suffix, told)]})
        return _mail(out)

    return count


def _indexed(shard: pa.Table, told: pa.Table) -> pa.Table:
    """Both transforms of a shard's text, rare words taken for ends of pieces."""
    rows = []
    if shard.num_rows and told.num_rows:
        data = np.frombuffer(shard.column("data")[0].as_py(), "<i4")
        answers = [[_unpacked(d) for d in a] for a in told.column("data").to_pylist()]
        local, ids = (np.concatenate(v) for v in zip(*answers, strict=True))
        order = np.argsort(ids)
        code = np.zeros(int(max(data.max(), local.max())) + 1, np.int32)
        code[local[order]] = np.arange(1, order.size + 1)
        text = np.concatenate([[0], code[data], [0]])
        # a word between ends is no phrase, an end after an end says nothing
        alone = np.zeros(text.size, bool)
        alone[1:-1] = (text[:-2] == 0) & (text[2:] == 0)
        text = np.where(alone, 0, text)
        text = text[(text > 0) | np.concatenate([[True], text[:-1] > 0])]
        used = np.unique(text)
        codes = ids[order][used[used > 0] - 1]
        text = np.searchsorted(used, text).astype(np.int32)
        if codes.size:
            packed = [_packed(v) for v in (codes, transform(text, LONGEST), transform(text[::-1], LONGEST))]
            rows.append([shard.column("shard")[0].as_py(), shard.column("lang")[0].as_py(), *packed])
    names = ("shard", "lang", "codes", "before", "after")
    kinds = (pa.string(), pa.string(), *[pa.binary()] * 3)
    columns = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _pairs(buckets: int):
    """Two-word phrases of each shard: its words extended to the right."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                after = Transform(_unpacked(row["after"]))
                words = Phrases.words(_unpacked(row["codes"]), after.bwt)
                found = grown(after, after, words, True)
                yield from _mail(list(_asks(row["lang"], row["shard"], *found, buckets))).to_batches()

    return ask


def _longer(to_the_right: bool, buckets: int):
    """From the phrases a shard knows and the answers about those one word longer: the latter, and
    what grows of them by one more word."""

    def grow(index: pa.Table, mail: pa.Table) -> pa.Table:
        rows: list[dict] = []
        told = [r["data"] for r in mail.to_pylist() if r["kind"] == "told"]
        if index.num_rows and told:
            one = index.to_pylist()[0]
            before, after = Transform(_unpacked(one["before"])), Transform(_unpacked(one["after"]))
            state = [r["data"] for r in mail.to_pylist() if r["kind"] == "state"]
            shorter = Phrases(*map(_unpacked, state[0])) if state else Phrases.words(_unpacked(one["codes"]), after.bwt)
            prefix, suffix, ids = (np.concatenate(v) for v in zip(*([_unpacked(d) for d in a] for a in told), strict=True))
            known = shorter.joined(before, after, prefix, suffix, ids)
            rows.append({"kind": "state", "shard": one["shard"], "data": [_packed(c) for c in known.columns()]})
            rows += _asks(one["lang"], one["shard"], *grown(before, after, known, to_the_right), buckets)
        return _mail(rows)

    return grow


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, phrase, words, f, firsts, rests, left, right, n): all phrases of 2 to LONGEST words
    that occur `least` times in texts (text, lang) of their language; n counts its words.

    firsts and rests hold, for each cut, the counts of the parts before and after it; left and
    right the largest count of the phrase with one more word on that side, null if that is rare.

    Each task's texts become shards of one language and about SHARD_WORDS words; their text moves
    once, to meet the ids of the words that are frequent over all shards. A shard is indexed in
    both directions; phrases grow by one word a round, on the right and the left in turn, from those
    that are frequent over all shards, and only if both parts are. A round sends a shard's
    distinct grown phrases to buckets, packed, which sum them over the shards and answer with those that are
    frequent. So no task holds more than a shard or a bucket of about BUCKET_ROWS, and no
    count depends on how texts are dealt.

    Null text: empty. Null lang: `und`. Very long texts: whole, in one shard. Repeated rows count
    each. No rows: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    name = f"collocations_{uuid.uuid4().hex}"
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}"

    def posted(mail: DataFrame, step: str) -> DataFrame:
        mail.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/{step}")
        return spark.read.schema(_MAIL).parquet(f"{folder}/{step}")

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where("text is not null")
    shards = settle(texts.mapInArrow(_sharded, _SHARD))
    in_shard = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = shards.agg(F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0))).first()[0]
    buckets = max(-(-rows // BUCKET_ROWS), 1)
    asked = shards.select("lang", "shard", "words", "counts").mapInArrow(_ask_words(buckets), _MAIL)
    answers = posted(asked.groupBy("lang", "bucket").applyInArrow(_count_words(buckets, least), _MAIL), "words")
    known = answers.where("kind = 'model'").select("lang", F.explode(F.arrays_zip("ids", "words", "f")).alias("w"))
    known = known.select("lang", F.col("w.ids").alias("id"), F.col("w.words").alias("phrase"), F.col("w.words").alias("last"), "w.f")
    none = F.array().cast("array<long>")
    known = settle(known.withColumns({"firsts": none, "rests": none}))

    told = answers.where("kind = 'told'").select(F.col("shard").alias("of"), "data")
    index = shards.select("shard", "lang", "data").groupBy("shard").cogroup(told.groupBy("of")).applyInArrow(_indexed, _INDEX)
    # bucketed by shard: answers travel to the index of their shard, which stays
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.write.bucketBy(files, "shard").option("path", f"{folder}/index").option("compression", "zstd").saveAsTable(name)
    index = spark.table(name)

    def wanted(known: DataFrame) -> int:
        """Buckets for what grows: it has no more members than the phrases it grows from occurrences."""
        return max(-(-(known.agg(F.sum("f")).first()[0] or 0) // BUCKET_ROWS), 1)

    levels = []
    state = None
    buckets = wanted(known)
    asked = index.select("shard", "lang", "codes", "after").mapInArrow(_pairs(buckets), _MAIL)
    for size in range(2, LONGEST + 1):
        counted = asked.groupBy("lang", "bucket").applyInArrow(_count_phrases(buckets, least), _MAIL)
        answers = posted(counted, f"counted{size}")
        model = answers.where("kind = 'model'").select("lang", F.explode(F.arrays_zip("ids", "prefix", "suffix", "f")).alias("w"))
        model = model.select("lang", F.col("w.ids").alias("id"), "w.prefix", "w.suffix", "w.f")
        p, s = (known.select(*(F.col(c).alias(f"{side}_{c}") for c in known.columns)) for side in ("p", "s"))
        joined = model.join(p, (F.col("lang") == F.col("p_lang")) & (F.col("prefix") == F.col("p_id")))
        joined = joined.join(s, (F.col("lang") == F.col("s_lang")) & (F.col("suffix") == F.col("s_id")))
        level = settle(
            joined.select(
                "lang", "id", "prefix", "suffix", F.concat_ws(" ", "p_phrase", "s_last").alias("phrase"), F.col("s_last").alias("last"), "f",
                F.array_append("p_firsts", F.col("p_f")).alias("firsts"), F.array_prepend("s_rests", F.col("s_f")).alias("rests"),
            )
        )
        levels.append((size, level))
        known = level.drop("prefix", "suffix")
        if size < LONGEST:
            buckets = wanted(known)
            mail = answers.where("kind = 'told'").select("kind", F.col("shard").alias("of"), "data")
            mail = mail if state is None else mail.unionByName(state)
            grow = _longer(size % 2 == 0, buckets)
            out = posted(index.groupBy("shard").cogroup(mail.groupBy("of")).applyInArrow(grow, _MAIL), f"grown{size}")
            asked = out.where("kind = 'ask'")
            state = out.where("kind = 'state'").select("kind", F.col("shard").alias("of"), "data")
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files lie in the checkpoint folder

    out = None
    for (size, level), longer in zip(levels, [*(t for _, t in levels[1:]), None], strict=True):
        level = level.withColumn("words", F.lit(size))
        for side, part in (("left", "suffix"), ("right", "prefix")):
            if longer is None:
                level = level.withColumn(side, F.lit(None).cast("long"))
                continue
            most = longer.groupBy(F.col("lang").alias("la"), F.col(part).alias("k")).agg(F.max("f").alias(side))
            level = level.join(most, (F.col("lang") == F.col("la")) & (F.col("id") == F.col("k")), "left").drop("la", "k")
        level = level.select("lang", "phrase", "words", "f", "firsts", "rests", "left", "right")
        out = level if out is None else out.unionByName(level)
    # occurrences of all words of a language, rare ones too
    return out.join(shards.groupBy("lang").agg(F.sum(in_shard).alias("n")), "lang")


def _exact(c: Column) -> Column:
    """Products of these have 38 digits, beyond 64 bits."""
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    score is floor(1000 * a * n / (l * r)) of the cut where that is lowest, the first of equal ones.
    A phrase goes if a phrase with one more word has `absorbed` percent of its occurrences; a
    phrase still longer with as many has one of those within it. Ties: more occurrences,
    then byte order. Nulls, long texts, repeats, empty tables: as `frequent_phrases`.
    """
    found = frequent_phrases(docs, least)
    longer = F.coalesce(F.greatest("left", "right"), F.lit(0))
    whole = _exact(longer) * 100 < _exact(F.col("f")) * absorbed

    def cut(x: Column, i: Column) -> Column:
        top_, below = F.lit(1000) * _exact(F.col("f")) * _exact(F.col("n")), _exact(x["firsts"]) * _exact(x["rests"])
        return F.struct(F.call_function("div", top_, below).alias("score"), (i + 1).alias("at"), x["firsts"].alias("l"), x["rests"].alias("r"))

    scored = found.where(whole).withColumn("cut", F.array_min(F.transform(F.arrays_zip("firsts", "rests"), cut)))
    scored = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

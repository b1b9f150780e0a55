"""SimHash near-duplicates found at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalograft.llm.common import local_components, set_aside, words
from catalograft.llm.components import components
from catalograft.session import settle

SHINGLE = 3
MOST_BITS = 3
SEED = 42
#: Rows one comparing task should get.
CELL_HOMES, CELL_COPIES, TASK_ROWS = 4_096, 400_000, 500_000

#: The anchors are words of the perfect binary Golay code, twice: bits 0-22 and bits 23-45.
#: Its length, its covering radius and its generator polynomial.
_N, _RADIUS, _GENERATOR = 23, 3, 0b101011100011


class _Golay:
    """Tables of the code: for every syndrome, the way to the anchors around a word."""

    def __init__(self, threshold: int):
        degree = _GENERATOR.bit_length() - 1
        self.syndromes = 1 << degree
        # x**i modulo the generator, so that a syndrome is a sum over bits
        powers, power = [], 1
        for _ in range(_N):
            powers.append(power)
            power <<= 1
            if power >> degree:
                power ^= _GENERATOR
        halves = []
        for low, size in ((0, 12), (12, 11)):
            table = np.zeros(1 << size, np.uint32)
            for bit in range(size):
                table[1 << bit : 2 << bit] = table[: 1 << bit] ^ np.uint32(powers[low + bit])
            halves.append(table)
        self.halves = halves
        code = self._codewords(degree)
        # the word of least weight with each syndrome
        single = [1 << i for i in range(_N)]
        leaders = np.zeros(self.syndromes, np.uint32)
        for word in [0, *single, *(x | y for x in single for y in single if x < y),
                     *(x | y | z for x in single for y in single if x < y for z in single if y < z)]:
            leaders[self.syndrome(np.array([word], np.uint32))[0]] = word
        self.leaders = leaders
        # by syndrome: code words within radius + threshold of the leader, nearest first
        steps, starts, counts = [], [0], []
        for leader in leaders:
            apart = np.bitwise_count(code ^ leader)
            near = np.flatnonzero(apart <= _RADIUS + threshold)
            order = near[np.argsort(apart[near], kind="stable")]
            level = np.maximum(apart[order].astype(np.int64) - _RADIUS, 0)
            steps.append(code[order])
            counts.append([int((level <= e).sum()) for e in range(threshold + 1)])
            starts.append(starts[-1] + order.size)
        self.steps = np.concatenate(steps)
        self.starts = np.array(starts[:-1], np.int64)
        #: by syndrome and budget e: how many anchors lie within radius + e
        self.counts = np.array(counts, np.int64)
        self.code = np.sort(code)

    @staticmethod
    def _codewords(degree: int) -> np.ndarray:
        code = np.zeros(1, np.uint32)
        for shift in range(_N - degree):
            code = np.concatenate([code, code ^ np.uint32(_GENERATOR << shift)])
        return code

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        low, high = self.halves
        return low[word & 0xFFF] ^ high[word >> 12]

    def home(self, word: np.ndarray) -> np.ndarray:
        """Number of the nearest anchor."""
        return np.searchsorted(self.code, word ^ self.leaders[self.syndrome(word)])

    def around(self, word: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word, number of the anchor, what of the budget it needs)."""
        syndrome = self.syndrome(word)
        n = self.counts[syndrome, budget]
        index = np.repeat(np.arange(word.size), n)
        place = np.arange(index.size) - np.repeat(np.cumsum(n) - n, n)
        at = self.starts[syndrome[index]] + place
        anchor = (word ^ self.leaders[syndrome])[index] ^ self.steps[at]
        anchor = np.searchsorted(self.code, anchor)
        need = (place[:, None] >= self.counts[syndrome[index]]).sum(axis=1)
        return index, anchor, need


_tables: dict[int, _Golay] = {}


def _golay(threshold: int) -> _Golay:
    if threshold not in _tables:
        _tables[threshold] = _Golay(threshold)
    return _tables[threshold]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one whole text."""
    found = words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(found) - shingle + 1, 1)
    ends = ends[min(shingle, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        pairs = zip(starts[i : min(n, i + (1 << 16))].tolist(), ends[i : i + (1 << 16)].tolist(), strict=False)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) per row; fp holds the 64 bits as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    keyed = docs.select("doc_id", "text", text_key(docs["text"]).alias("text_key"))
    return keyed.mapInArrow(compute, "doc_id long, text_key long, fp long")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(text)


def _words_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << _N) - 1)
    return (fp & mask).astype(np.uint32), ((fp >> np.uint64(_N)) & mask).astype(np.uint32)


def _counted(batches: Iterator[pa.RecordBatch], most_bits: int) -> Iterator[pa.RecordBatch]:
    golay = _golay(most_bits)
    homes = np.zeros(golay.code.size, np.int64)
    copies = np.zeros(golay.code.size, np.int64)
    for batch in batches:
        first, _ = _words_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        homes += np.bincount(golay.home(first), minlength=homes.size)
        _, anchor, _ = golay.around(first, np.full(first.size, most_bits))
        copies += np.bincount(anchor, minlength=homes.size)
    used = np.flatnonzero(copies)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (used, homes[used], copies[used])], ["anchor", "homes", "copies"]
    )


def near_pairs(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints `fp` at most `most_bits` apart.

    Each fingerprint has a home: the nearest anchor, within the covering radius in both
    halves. It is copied to every anchor another fingerprint at most `most_bits` away can
    have as home: those within radius + e in one half and radius + f in the other,
    e + f <= most_bits. So each pair meets at the home of either; homes are compared with the
    copies there. Of the links of one task only a spanning forest is kept.

    What is shuffled is a fingerprint per anchor of the first half; the receiver works out the
    second. An anchor with many homes or copies is cut into a grid of cells.
    """
    counts = {
        r["anchor"]: (r["homes"], r["copies"])
        for r in fps.mapInArrow(
            lambda batches: _counted(batches, most_bits), "anchor long, homes long, copies long"
        )
        .groupBy("anchor")
        .agg(F.sum("homes").alias("homes"), F.sum("copies").alias("copies"))
        .collect()  # one row per anchor: 4,096 at most
    }
    size = len(_golay(most_bits).code)
    rows = np.array([counts.get(i, (0, 0)) for i in range(size)], np.int64)
    home_cells = np.maximum(-(-rows[:, 0] // CELL_HOMES), 1)
    copy_cells = np.maximum(-(-rows[:, 1] // CELL_COPIES), 1)
    # neighbouring anchors share a task while they are small
    group = (np.cumsum(rows.sum(axis=1)) // TASK_ROWS).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = _golay(most_bits)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            first, _ = _words_of(fp)
            home = golay.home(first)
            index, anchor, need = golay.around(first, np.full(first.size, most_bits))
            parts = []
            spread = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for side, who, at, level in ((0, np.arange(fp.size), home, np.zeros(fp.size, np.int64)), (1, index, anchor, need)):
                own, other = (home_cells, copy_cells) if side == 0 else (copy_cells, home_cells)
                n = other[at]
                rep = np.repeat(np.arange(who.size), n)
                j = np.arange(rep.size) - np.repeat(np.cumsum(n) - n, n)
                mine = (spread[who[rep]] % own[at[rep]].astype(np.uint64)).astype(np.int64)
                i, k = (mine, j) if side == 0 else (j, mine)
                alone = (home_cells[at[rep]] == 1) & (copy_cells[at[rep]] == 1)
                key = np.where(alone, group[at[rep]] << 1, (((at[rep] << 24) | (i << 12)) << 12 | k) << 1 | 1)
                parts.append((key, fp[who[rep]], at[rep], level[rep] + 10 * (side == 0)))
            key, value, at, level = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            key, value, at, level = key[order], value[order], at[order], level[order]
            cuts = np.flatnonzero(np.diff(key)) + 1
            begins, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [key.size]])
            if key.size:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[begins], pa.int64()),
                        pa.array([value[s:e].tobytes() for s, e in zip(begins, stops, strict=True)], pa.binary()),
                        pa.array([at[s:e].astype("<u2").tobytes() for s, e in zip(begins, stops, strict=True)], pa.binary()),
                        pa.array([level[s:e].astype("u1").tobytes() for s, e in zip(begins, stops, strict=True)], pa.binary()),
                    ],
                    ["cell", "fp", "anchor", "level"],
                )

    def compare(cell: pa.Table) -> pa.Table:
        fp, anchor, level = (
            np.frombuffer(b"".join(cell.column(c).to_pylist()), kind)
            for c, kind in (("fp", "<u8"), ("anchor", "<u2"), ("level", "u1"))
        )
        a, b = _compared(fp, anchor.astype(np.int64), level, most_bits)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    dealt = fps.mapInArrow(deal, "cell long, fp binary, anchor binary, level binary")
    return dealt.groupBy("cell").applyInArrow(compare, "a long, b long")


def _compared(fp, anchor, level, most_bits) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the homes and the copies of a cell."""
    golay = _golay(most_bits)
    is_home = level >= 10
    homes, at = fp[is_home], anchor[is_home]
    key = at << 12 | golay.home(_words_of(homes)[1])
    order = np.argsort(key, kind="stable")
    homes, key = homes[order], key[order]
    copies, at, level = fp[~is_home], anchor[~is_home], level[~is_home].astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, copies.size, 20_000):
        part = copies[i : i + 20_000]
        index, second, _ = golay.around(_words_of(part)[1], most_bits - level[i : i + 20_000])
        wanted = at[i : i + 20_000][index] << 12 | second
        low, high = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
        hit = np.flatnonzero(high > low)
        low, n, index = low[hit], (high - low)[hit], index[hit]
        total = np.cumsum(n)
        if not total.size:
            continue
        # pairs in steps of about a million
        steps = np.searchsorted(total, np.arange(1 << 20, total[-1], 1 << 20)) + 1
        bounds = np.unique(np.concatenate([[0], steps, [n.size]]))
        for begin, stop in zip(bounds, bounds[1:], strict=False):
            m = n[begin:stop]
            rep = np.repeat(np.arange(begin, stop), m)
            x = homes[low[rep] + np.arange(rep.size) - np.repeat(np.cumsum(m) - m, m)]
            y = part[index[rep]]
            apart = np.bitwise_count(x ^ y)
            near = (apart <= most_bits) & (apart > 0)
            if near.any():
                found.append(_forest(x[near], y[near]))
        if len(found) > 50:
            found = [_forest(*(np.concatenate(c) for c in zip(*found, strict=True)))]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, least = local_components(a, b)
    keep = nodes != least
    return nodes[keep], least[keep]


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text_key, fp, component, component_id) per row.

    component_id is the smallest doc_id reachable, component a fingerprint that names the same
    group where ids are null or repeated.

    In: doc_id, text (other columns are ignored). Documents of equal fingerprint are linked
    without being compared; links between different fingerprints come from `near_pairs`.

    Null or empty text: fingerprint 0, linked like any other. Fewer words than a shingle: the
    whole sequence. Repeated rows: the same component. A null doc_id is never smallest; a
    component of null ids only is null. No rows: no rows.
    """
    marked = settle(fingerprints(docs, shingle))
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components(near_pairs(distinct.select("fp"), most_bits))
    # fingerprints without links are components of their own
    joined = distinct.join(reached, distinct["fp"] == reached["id"], "left")
    placed = settle(joined.select("fp", "least", F.coalesce("component", "fp").alias("c")))
    smallest = placed.groupBy("c").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "c").select(F.col("fp").alias("f"), F.col("c").alias("component"), "component_id")
    return marked.join(named, marked["fp"] == named["f"]).drop("f")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of each group the one of smallest id, null ids last.

    Columns but doc_id and text may have any name and type."""
    docs, named = set_aside(docs, "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_key").alias("k")))
    stay = found.groupBy("component").agg(first.alias("s")).select(F.col("s.i").alias("__i"), F.col("s.k").alias("__t")).distinct()
    keyed = docs.withColumn("__k", text_key(docs["text"]))
    met = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__t")), "left_semi")
    copy = Window.partitionBy("doc_id", "__k").orderBy(F.lit(0))
    return named(met.withColumn("__n", F.row_number().over(copy)).where("__n = 1").select(docs.columns))

"""Quality of documents: histogram gradient-boosted trees over statistics of the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalograft.llm.common import LOWER, crc_of_id, hash_words
from catalograft.llm.vectors import matrix

#: The trees learn from about so many labelled rows at most; every row is scored.
FIT_ROWS = 20_000
#: Trees, their depth, bins of a feature, share of each tree that counts, least rows of a leaf.
TREES, DEPTH, BINS, RATE, LEAF_ROWS = 120, 4, 64, 0.1, 8
#: Penalty on leaf values.
RIDGE = 1.0
#: A text whose score is lower is predicted to be of low quality.
THRESHOLD = 0.3
#: Words of the windows whose worst one is a feature.
WINDOW = 24

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 1, 2, 3, 4
_CLASS[list(b".,;:!?'\"-()")], _CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")], _CLASS[128:] = 5, 6, 7
_CLASSES = 8

FEATURES = (
    "bytes", "words", "lines", "mean_word", "longest_word", "distinct", "commonest", "repeated", "worst_repeated",
    "shouted", "worst_shouted", "marked", "worst_marked", "repeated_lines", "ended_lines", "mean_line", "entropy",
    "exclamations", "short_words", *(f"class_{i}" for i in range(_CLASSES)),
)


def _worst(flags: np.ndarray) -> float:
    """Largest share of flags in a window of WINDOW words; of all words if there are fewer."""
    if flags.size <= WINDOW:
        return float(flags.mean()) if flags.size else 0.0
    total = np.concatenate([[0], np.cumsum(flags)])
    return float((total[WINDOW:] - total[:-WINDOW]).max()) / WINDOW


def statistics(text: str | None) -> list[float]:
    """The features of a whole text; all 0 for null and empty ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(len(raw)), *[0.0] * (len(FEATURES) - 1)]
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    classes = np.bincount(_CLASS, weights=counts, minlength=_CLASSES) / len(raw)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    # by word: its bytes of each kind, from running sums over the words side by side
    flat = _CLASS[np.frombuffer(b"".join(words), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    letters = np.add.reduceat((flat == 1) | (flat == 7), starts)
    capitals = np.add.reduceat(flat == 2, starts)
    symbols = np.add.reduceat(flat == 6, starts)
    hashed = hash_words([w.translate(LOWER) for w in words])
    _, of_word = np.unique(hashed, return_counts=True)
    again = hashed[1:] == hashed[:-1]
    shouted = (capitals > letters) & (capitals > 1)
    marked = symbols > 0
    lines = [line for line in raw.splitlines() if line.strip()]
    share = counts[counts > 0] / len(raw)
    return [
        float(len(raw)), float(n), float(len(lines)), float(sizes.mean()), float(sizes.max()), of_word.size / n, float(of_word.max() / n),
        float(again.mean()) if n > 1 else 0.0, _worst(again), float(shouted.mean()), _worst(shouted), float(marked.mean()), _worst(marked),
        1 - len(set(lines)) / len(lines), sum(line.rstrip()[-1:] in (b".", b"!", b"?", b'"') for line in lines) / len(lines), n / len(lines),
        float(-(share * np.log2(share)).sum()), float(counts[33] / n), float((sizes <= 2).mean()), *classes,
    ]


@dataclass
class Trees:
    """All trees side by side: node k of tree t asks whether a feature is at most a border, then goes
    to 2k+1 (yes) or 2k+2; nodes of the last level hold values."""

    feature: np.ndarray  # (trees, inner nodes)
    border: np.ndarray  # (trees, inner nodes); infinite where a node is not split
    value: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features, all rows of a tree level at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, border, value in zip(self.feature, self.border, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 2 - (x[rows, feature[node]] <= border[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
        """Boosting of the logistic loss: each tree fits its gradient by the gains of histogram borders."""
        prior = (y.sum() + 0.5) / (len(y) + 1)
        base = float(np.log(prior / (1 - prior)))
        inner, leaves = 2**depth - 1, 2**depth
        if not len(y) or y.min() == y.max():
            return cls(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
        borders = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS)) for column in x.T]
        binned = np.column_stack([np.searchsorted(b, column) for b, column in zip(borders, x.T, strict=True)])
        slot = binned + np.arange(x.shape[1]) * BINS
        total = np.full(len(y), base)
        model = cls(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-total))
            gradient, curve = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, many = 2**level - 1, 2**level
                cell = ((node - first)[:, None] * x.shape[1] * BINS + slot).ravel()
                g, h, n = (
                    np.bincount(cell, np.repeat(w, x.shape[1]), many * x.shape[1] * BINS).reshape(many, x.shape[1], BINS).cumsum(axis=2)
                    for w in (gradient, curve, np.ones(len(y)))
                )
                rest_g, rest_h, rest_n = (v[:, :, -1:] - v for v in (g, h, n))
                gain = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + RIDGE)
                gain[(n < LEAF_ROWS) | (rest_n < LEAF_ROWS)] = 0
                best = gain.reshape(many, -1).argmax(axis=1)
                split = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
                feature, at = best // BINS, best % BINS
                model.feature[t, first : first + many] = feature
                model.border[t, first : first + many] = [
                    borders[f][b] if s else np.inf for f, b, s in zip(feature, at, split, strict=True)
                ]
                mine = node - first
                low = ~split[mine] | (binned[np.arange(len(y)), feature[mine]] <= at[mine])
                node = 2 * node + 2 - low
            leaf = node - inner
            sums = [np.bincount(leaf, w, leaves) for w in (gradient, curve)]
            model.value[t] = -RATE * sums[0] / (sums[1] + RIDGE)
            total += model.value[t][leaf]
        return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Trees from documents (doc_id, text) with labels (doc_id, quality 0 or 1).

    Of more than `rows` labelled ids those of smallest hash are learned from. Other labels than 0 and 1
    and null ids are left out; an id with both labels counts with each. Without labels or with one kind
    the score is the share of label 1.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y")).distinct()
    n = usable.count()
    # a share of the hashes: about `rows` ids, and never more than twice as many
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(rows / max(n, 1), 1) * (1 << 20))
    picked = usable.where(share).orderBy("doc_id", "y").limit(2 * rows).select(F.col("doc_id").alias("k"), "y")
    known = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("k")).select("text", "y")
    # a repeated id brings more rows: first of equal texts, then no more than twice the bound
    known = known.distinct().mapInArrow(_features, "x array<double>, y double")
    learned = known.orderBy(F.xxhash64("x", "y"), "x", "y").limit(2 * rows).toArrow().combine_chunks()
    if not learned.num_rows:
        return Trees.train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return Trees.train(matrix(learned.column("x").combine_chunks()), learned.column("y").to_numpy())


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """All rows (every column) plus quality_score, 0 to 1, higher where label 1 is likelier.

    A column of that name is replaced. Null and empty texts: the score of a text with no words.
    Very long texts: all of them counts. Repeated rows: the same score. No rows: no rows.
    """
    docs = docs.drop("quality_score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            x = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(score, T.StructType(list(docs.schema.fields)).add("quality_score", "double"))


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 5 == 0

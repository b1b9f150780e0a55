"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else, byte by byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_UPPER_CASE, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER_CASE, _LOWER_CASE)


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with all columns but `used` under neutral names, and how to name them back.

    An operator that adds columns of its own can then not meet one of the same name, in
    whatever case it is written.
    """
    prefix = "_kept_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    names = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns) if c not in used}
    back = {neutral: c for c, neutral in names.items()}

    def named(df: DataFrame) -> DataFrame:
        return df.toDF(*(back.get(c, c) for c in df.columns))

    return docs.toDF(*(names.get(c, c) for c in docs.columns)), named


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; of the empty text for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
_PLACES = np.random.default_rng(2).integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text; bytes.split knows the same six spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def hash_words(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word, over flat arrays instead of word by word."""
    if not found:
        return np.zeros(0, np.uint64)
    out = []
    begin = taken = 0
    for i, word in enumerate(found):
        taken += len(word)
        if taken >= 1 << 20 or i + 1 == len(found):
            part = found[begin : i + 1]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            starts = np.cumsum(sizes) - sizes
            data = np.frombuffer(b"".join(part), np.uint8)
            place = np.arange(data.size) - np.repeat(starts, sizes)
            values = mix64(_BYTES[data] + (place >> 12).astype(np.uint64)) * _PLACES[place & 4095]
            out.append(mix64(np.add.reduceat(values, starts) + sizes.astype(np.uint64)))
            begin, taken = i + 1, 0
    return np.concatenate(out)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of links (a, b), and for each the smallest end it reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(nodes.size)
    x, y = ends[: a.size], ends[a.size :]
    while x.size:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            apart = label[x] != label[y]
            if not apart.any():
                break
            x, y = x[apart], y[apart]
    return nodes, nodes[label]

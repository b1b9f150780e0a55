"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalograft.llm.common import LOWER, crc_of_id

#: The network learns from at most so many documents of a language and words of a document.
FIT_DOCS, FIT_WORDS = 400, 200
#: Hidden units of each direction; training steps; words of a step.
HIDDEN, STEPS, BATCH = 16, 240, 384
#: A sequence is a word and the space after it; longer words are cut into pieces of so many bytes.
LONGEST = 32
UNKNOWN = "und"
#: Distinct words a worker remembers.
_REMEMBERED = 200_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    """A gated recurrent unit: update, reset and candidate weights side by side."""

    by_byte: np.ndarray  # (256, 3h): input weights of each byte with the bias
    inner: np.ndarray  # (h, 3h)

    @classmethod
    def fresh(cls, rng: np.random.Generator, hidden: int) -> Direction:
        return cls(
            rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32),
        )

    def run(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (t, n, h) of sequences (n, t) of equal length."""
        hidden = self.inner.shape[0]
        state = np.zeros((len(data), hidden), np.float32)
        out = np.empty((data.shape[1], len(data), hidden), np.float32)
        for t in range(data.shape[1]):
            given = self.by_byte[data[:, t]]
            inner = state @ self.inner
            gates = _sigmoid(given[:, : 2 * hidden] + inner[:, : 2 * hidden])
            update, reset = gates[:, :hidden], gates[:, hidden:]
            new = np.tanh(given[:, 2 * hidden :] + reset * inner[:, 2 * hidden :])
            if keep is not None:
                keep.append((state, update, reset, new, inner[:, 2 * hidden :]))
            state = new + update * (state - new)
            out[t] = state
        return out

    def back(self, data: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by backpropagation through time from those of the states."""
        d_inner, d_byte = np.zeros_like(self.inner), np.zeros_like(self.by_byte)
        d_state = np.zeros_like(d_out[0])
        for t in range(data.shape[1] - 1, -1, -1):
            state, update, reset, new, inner_new = kept[t]
            d_state = d_state + d_out[t]
            a_new = d_state * (1 - update) * (1 - new * new)
            a_update = d_state * (state - new) * update * (1 - update)
            a_reset = a_new * inner_new * reset * (1 - reset)
            through = np.concatenate([a_update, a_reset, a_new * reset], axis=1)
            d_inner += state.T @ through
            np.add.at(d_byte, data[:, t], np.concatenate([a_update, a_reset, a_new], axis=1))
            d_state = d_state * update + through @ self.inner.T
        return d_byte, d_inner


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (2h + 1, languages), the last row is the bias
    letters: str = ""  # those of the words learned from, small and capital

    @classmethod
    def train(cls, words: list[tuple[str, list[bytes]]], seed: int = 11) -> Network:
        """Learn from (language, words); every position of a word carries the language."""
        rng = np.random.default_rng(seed)
        languages = sorted({language for language, _ in words})
        net = cls(
            languages,
            Direction.fresh(rng, HIDDEN),
            Direction.fresh(rng, HIDDEN),
            rng.normal(0, 0.1, (2 * HIDDEN + 1, len(languages))).astype(np.float32),
        )
        by_size: dict[int, list[tuple[bytes, int]]] = {}
        for language, found in words:
            for word in found:
                for piece in pieces(word):
                    by_size.setdefault(len(piece), []).append((piece, languages.index(language)))
        if len(languages) < 2 or not by_size:
            return net
        ready = []
        for size, items in sorted(by_size.items()):
            data = np.frombuffer(b"".join(p for p, _ in items), np.uint8).reshape(-1, size)
            label = np.array([n for _, n in items])
            ready.append((data, label))
        share = np.bincount(np.concatenate([y for _, y in ready]), minlength=len(languages))
        mass = np.array([(1 / share[y]).sum() for _, y in ready])
        params = [net.forward.by_byte, net.forward.inner, net.backward.by_byte, net.backward.inner, net.out]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            data, label = ready[rng.choice(len(ready), p=mass / mass.sum())]
            weight = 1 / share[label]
            pick = rng.choice(len(data), min(BATCH, 4 * len(data)), p=weight / weight.sum())
            grads = net._gradients(data[pick], label[pick])
            rate = 0.02 * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
            for p, g, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return net

    def _states(self, data: np.ndarray, keep: tuple = (None, None)) -> np.ndarray:
        ahead = self.forward.run(data, keep[0])
        behind = self.backward.run(data[:, ::-1], keep[1])[::-1]
        return np.concatenate([ahead, behind], axis=2)

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (t, n, languages) of every position of sequences (n, t)."""
        return self._soft(self._states(data))

    def _soft(self, states: np.ndarray) -> np.ndarray:
        scores = states @ self.out[:-1] + self.out[-1]
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        return scores / scores.sum(axis=2, keepdims=True)

    def _gradients(self, data: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        kept: tuple[list, list] = ([], [])
        states = self._states(data, kept)
        wrong = self._soft(states)
        wrong[:, np.arange(len(label)), label] -= 1
        wrong /= wrong.shape[0] * wrong.shape[1]
        flat, flat_wrong = states.reshape(-1, states.shape[2]), wrong.reshape(-1, wrong.shape[2])
        d_out = np.concatenate([flat.T @ flat_wrong, flat_wrong.sum(axis=0, keepdims=True)])
        d_states = wrong @ self.out[:-1].T
        ahead = self.forward.back(data, kept[0], d_states[:, :, :HIDDEN])
        behind = self.backward.back(data[:, ::-1], kept[1], d_states[::-1, :, HIDDEN:])
        return [*ahead, *behind, d_out]

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """By word: the sums over its positions of the probabilities."""
        total = np.zeros((len(words), len(self.languages)), np.float32)
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        for i, word in enumerate(words):
            for piece in pieces(word):
                by_size.setdefault(len(piece), []).append((i, piece))
        for size, items in by_size.items():
            for s in range(0, len(items), 4096):
                part = items[s : s + 4096]
                data = np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(-1, size)
                np.add.at(total, [i for i, _ in part], self.positions(data).sum(axis=0))
        return total


def pieces(word: bytes) -> list[bytes]:
    """A word and the space after it, in pieces of at most LONGEST bytes."""
    word += b" "
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def label_positions(net: Network, text: str) -> list[tuple[bytes, list[str]]]:
    """Each piece of a text with the language of every position."""
    out = []
    for word in _split(text):
        for piece in pieces(word):
            best = net.positions(np.frombuffer(piece, np.uint8).reshape(1, -1))[:, 0].argmax(axis=1)
            out.append((piece, [net.languages[i] for i in best]))
    return out


def fit(labelled: DataFrame, docs: int = FIT_DOCS, words: int = FIT_WORDS) -> Network | None:
    """Train on rows (doc_id, text, lang): `docs` documents of each language, those of smallest
    hash, and `words` words of each, drawn from the whole text. None without usable rows."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    picked = _first_of_each(labelled.select("doc_id", "lang"), ["doc_id"], docs)
    # at most `docs` ids of a language
    texts = labelled.join(F.broadcast(picked.select(F.col("doc_id").alias("d"), F.col("lang").alias("l"))),
                          F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("lang") == F.col("l")), "left_semi")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = []
            for text in batch.column(0):
                found = _split(text.as_py())
                rng = np.random.default_rng(zlib.crc32(text.as_py().encode("utf-8", "surrogatepass")))
                some = rng.choice(len(found), min(words, len(found)), replace=False) if found else []
                drawn.append(b" ".join(found[i][: 4 * LONGEST] for i in sorted(some)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(drawn, pa.binary())], ["lang", "words"])

    # repeated ids can bring more rows than ids
    drawn = texts.select("text", "lang").mapInArrow(draw, "lang string, words binary")
    kept = _first_of_each(drawn, ["words"], docs).select("lang", "words").collect()
    ready = [(r["lang"], bytes(r["words"]).split()) for r in sorted(kept, key=lambda r: (r["lang"], bytes(r["words"])))]
    if not any(found for _, found in ready):
        return None
    net = Network.train(ready)
    # a word may be cut within a letter
    seen = set().union(*(set(w.decode("utf-8", "ignore")) for _, found in ready for w in found))
    net.letters = "".join(sorted(c for c in {d for c in seen for d in c + c.lower() + c.upper()} if c.isalpha()))
    return net


def of_learned_letters(text: Column, net: Network | None, least: float = 0.5) -> Column:
    """Whether at least the share `least` of the letters of a text are letters the network learned from.

    Its probabilities sum to one whatever it reads, so a script it never met can score high.
    """
    letters = "".join(f"\\x{{{ord(c):x}}}" for c in net.letters) if net else ""
    # counts copy no text; most texts hold no other letter and need no second count
    foreign = F.regexp_count(text, F.lit(f"[\\p{{L}}&&[^{letters}]]" if letters else r"\p{L}"))
    known = F.regexp_count(text, F.lit(f"[{letters}]")) if letters else F.lit(0)
    return F.when(foreign == 0, F.lit(True)).otherwise(known >= least * (known + foreign))


def _first_of_each(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most `most` rows of each language, those of smallest hash.

    First of each of 64 shares of a language, then of those, so that one task never
    gets more than 64 times `most` rows, however many hold the same language.
    """
    hashed = rows.withColumn("__h", F.xxhash64(*by))
    for shares in (64, 1):
        share = F.pmod("__h", F.lit(shares))
        order = Window.partitionBy("lang", share).orderBy("__h", *(F.col(c).asc_nulls_last() for c in by))
        hashed = hashed.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    return hashed.drop("__h", "__n")


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """All rows (every column) plus lang_pred and lang_score; columns named so give way.

    Every byte position of a text is labelled by the network run over its word; a document's
    probabilities are the means over its positions. A word's sums depend on the word alone,
    so equal words of a task are run once.

    Null text, no letter or no network: `und` with score 0. Very long texts: all words count.
    Repeated rows: the same answer. No rows: no rows.
    """
    docs = docs.drop("lang_pred", "lang_score")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(net)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            names: list[str] = []
            scores: list[float] = []
            some: list[str | None] = []
            size = 0
            for i in range(len(texts)):
                some.append(texts[i].as_py())
                size += len(some[-1] or "")
                if size > 1 << 20 or i + 1 == len(texts):
                    for name, score in memory.judge(some):
                        names.append(name)
                        scores.append(score)
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "lang_score"],
            )

    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double")
    return docs.mapInArrow(predict, schema)


class _Memory:
    """Sums of the words met by a task."""

    def __init__(self, net: Network | None):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(self.net.languages) if self.net else 0), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        good = [bool(self.net and t and any(map(str.isalpha, t))) for t in texts]
        found = [_split(t) if g else [] for t, g in zip(texts, good, strict=True)]
        if len(self.known) > _REMEMBERED:
            self.clear()
        new = [w for w in set().union(*found) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, self.net.pooled(new)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int64, len(new)) + 1])
        out = []
        for words, g in zip(found, good, strict=True):
            if not g:
                out.append((UNKNOWN, 0.0))
                continue
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            mean = self.sums[at].sum(axis=0, dtype=np.float64) / self.sizes[at].sum()
            best = int(mean.argmax())
            out.append((self.net.languages[best], min(1.0, float(mean[best]))))
        return out


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 4 == 2

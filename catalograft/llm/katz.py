"""Katz backoff scores: counts gathered from and answered to batches of documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalograft.llm.common import crc_of_id, hash_words, mix64, words
from catalograft.session import checkpoint_dir

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a batch, requests one counting task should get, and occurrences of a context in one bucket.
BATCH_TOKENS, BUCKET_ROWS, CONTEXT_ROWS = 1_500_000, 1_000_000, 500_000
#: What stands for the end of a text and for what precedes its first word; no word hashes so.
_END, _START = np.uint64(0x656E64), np.uint64(0x7374617274)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray, dtype: str, width: int | None = None) -> bytes:
    """An array as compressed byte planes, the lowest `width` bytes of each value."""
    values = np.ascontiguousarray(values, dtype)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T[:width]
    head = len(values).to_bytes(8, "little")
    return head + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(dtype)
    raw = np.frombuffer(zstandard.decompress(data[8:]), np.uint8)
    planes = np.zeros((kind.itemsize, n), np.uint8)
    if n:
        raw = raw.reshape(-1, n)
        planes[: len(raw)] = raw
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


_BATCH = "batch long, data array<binary>, n_train_docs long, n_tokens long"
_ANSWER = "kind string, batch long, bucket long, data array<binary>, stats array<long>"


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text, held_out) as batches of numbered words."""
    number = TaskContext.get().partitionId() << 24
    found: list[bytes] = []
    docs: list[tuple] = []

    def flush() -> pa.RecordBatch:
        sizes = np.array([n for _, _, n in docs], np.int64)
        ends = np.cumsum(sizes) - 1
        tokens = np.empty(int(sizes.sum()), np.uint64)
        is_end = np.zeros(tokens.size, bool)
        is_end[ends] = True
        tokens[is_end] = _END
        tokens[~is_end] = hash_words(found)
        codes, vocabulary = pd.factorize(tokens)
        # frequent words first: small numbers take less room
        order = np.argsort(-np.bincount(codes, minlength=vocabulary.size), kind="stable")
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        codes, vocabulary = place[codes], vocabulary[order]
        held = np.array([h for _, h, _ in docs], bool)
        train = np.bincount(codes[np.repeat(~held, sizes)], minlength=vocabulary.size)
        ids = np.array([0 if d is None else d for d, _, _ in docs], np.int64)
        null = np.array([d is None for d, _, _ in docs], np.uint8)
        data = [
            _packed(ids, "<i8"), _packed(null, "u1"), _packed(held, "u1"), _packed(sizes, "<i8"),
            _packed(vocabulary, "<u8"), _packed(train, "<i8"), _packed(codes, "<i4"),
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([data], pa.list_(pa.binary())),
                pa.array([int((~held).sum())], pa.int64()),
                pa.array([tokens.size], pa.int64()),
            ],
            ["batch", "data", "n_train_docs", "n_tokens"],
        )

    for batch in batches:
        for doc_id, text, held in zip(*batch.columns, strict=True):
            more = words(text.as_py())
            found += more
            docs.append((doc_id.as_py(), held.as_py(), len(more) + 1))
            if len(found) + len(docs) >= BATCH_TOKENS:
                yield flush()
                found, docs, number = [], [], number + 1
    if docs:
        yield flush()


class _Batch:
    """A batch as it was numbered."""

    def __init__(self, table: pa.Table):
        data = table.column("data")[0].as_py()
        kinds = ("<i8", "u1", "u1", "<i8", "<u8", "<i8", "<i4")
        self.ids, self.null, held, self.sizes, self.words, self.train, codes = map(_unpacked, data, kinds)
        self.number = table.column("batch")[0].as_py()
        self.held, self.codes = held.astype(bool), codes.astype(np.int64)

    def word_order(self, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        return _dealt((self.words % np.uint64(buckets)).astype(np.int64))

    def counted(self, answers: list[dict], buckets: int) -> np.ndarray:
        """Training counts of the batch's words from the answers."""
        order, cuts = self.word_order(buckets)
        by_bucket = {a["bucket"]: a["data"][0] for a in answers if a["kind"] == "word"}
        out = np.zeros(self.words.size, np.int64)
        for bucket, s, e in cuts:
            out[order[s:e]] = _unpacked(by_bucket[bucket], "<i8")
        return out


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by bucket, and (bucket, begin, end) of each run in it."""
    order = np.argsort(bucket, kind="stable")
    if not order.size:
        return order, []
    runs = bucket[order]
    cuts = np.flatnonzero(np.diff(runs)) + 1
    begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [runs.size]])
    return order, list(zip(runs[begins].tolist(), begins.tolist(), ends.tolist(), strict=True))


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    names = ("kind", "batch", "bucket", "data", "stats")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _tallied(counts: np.ndarray) -> list[int]:
    """How many have count 1, 2, ... DISCOUNTED + 1; the sum; how many have any."""
    small = np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return [*small[1 : DISCOUNTED + 2].tolist(), int(counts.sum()), int((counts > 0).sum())]


def discounts(tally: list[int]) -> np.ndarray:
    """Good-Turing factors d[r] of counts r up to DISCOUNTED (d[0] unused).

    Katz's formula; where it gives nothing between 0 and 1, as on few counts or among many
    copies, half an occurrence is taken away instead.
    """
    n = [0, *tally[: DISCOUNTED + 1]]
    out = np.ones(DISCOUNTED + 1)
    for r in range(1, DISCOUNTED + 1):
        d = -1.0
        if n[1] and n[r]:
            common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
            if common < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """Discounted word probabilities; what is left over is the one unknown word's."""

    def __init__(self, tally: list[int]):
        self.factor = discounts(tally)
        self.total, self.distinct = tally[-2], tally[-1]
        taken = sum((1 - self.factor[r]) * r * tally[r - 1] for r in range(1, DISCOUNTED + 1))
        extra = 0 if taken > 0 else 1
        self.size = self.total + extra
        self.unknown = (taken + extra) / self.size

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        factor = np.where(counts <= DISCOUNTED, self.factor[np.minimum(counts, DISCOUNTED)], 1.0)
        return np.where(counts > 0, factor * counts / self.size, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


class _Pairs:
    """The distinct word pairs of a batch and which bucket is asked about each.

    A pair lies in the bucket of its context; a context that is frequent in training is spread
    over several by its followers. Pairs with an unknown word are known to have count 0.
    """

    def __init__(self, batch: _Batch, counts: np.ndarray, train_docs: int, buckets: int):
        size = batch.words.size
        self.contexts = np.concatenate([batch.words, [_START]]) >> np.uint64(16)
        known = np.concatenate([counts, [train_docs]])
        before = np.concatenate([[size], batch.codes[:-1]]) if batch.codes.size else batch.codes
        starts = np.cumsum(batch.sizes) - batch.sizes
        before[starts] = size
        self.before = before
        asked = (known[before] > 0) & (counts[batch.codes] > 0)
        keys, inverse = np.unique(before[asked] * (size + 1) + batch.codes[asked], return_inverse=True)
        self.of_token = np.full(batch.codes.size, -1, np.int64)
        self.of_token[asked] = inverse
        in_train = np.repeat(~batch.held, batch.sizes)[asked]
        self.train = np.bincount(inverse[in_train], minlength=keys.size)
        self.context, self.word = keys // (size + 1), keys % (size + 1)
        spread = 1 + known // CONTEXT_ROWS
        follower = self.contexts[:-1]
        salt = follower[self.word] % spread[self.context].astype(np.uint64)
        self.follower, self.word_count = follower, counts
        order, cuts = _dealt(self._bucket(self.context, salt, buckets))
        # every known context is asked about, in all its buckets: an unknown word may follow it
        present = np.unique(before[known[before] > 0])
        wide = spread[present]
        who = np.repeat(present, wide)
        salts = np.arange(who.size) - np.repeat(np.cumsum(wide) - wide, wide)
        at = self._bucket(who, salts.astype(np.uint64), buckets)
        runs = {b: order[s:e] for b, s, e in cuts}
        self.asked: list[tuple[int, np.ndarray, np.ndarray]] = []  # bucket, pairs, contexts
        for b in sorted(set(runs) | set(at.tolist())):
            pairs = runs.get(b, np.zeros(0, np.int64))
            self.asked.append((b, pairs, np.unique(np.concatenate([self.context[pairs], who[at == b]]))))

    def _bucket(self, context: np.ndarray, salt: np.ndarray, buckets: int) -> np.ndarray:
        return (mix64(self.contexts[context] + salt * _ODD) % np.uint64(buckets)).astype(np.int64)

    def requests(self, number: int) -> Iterator[tuple[int, int, list[bytes]]]:
        for bucket, pairs, contexts in self.asked:
            runs = np.bincount(np.searchsorted(contexts, self.context[pairs]), minlength=contexts.size)
            yield bucket, number, [
                _packed(self.contexts[contexts], "<u8", 6),
                _packed(runs, "<i4"),
                _packed(self.follower[self.word[pairs]], "<u8", 6),
                _packed(self.word_count[self.word[pairs]], "<i8"),
                _packed(self.train[pairs], "<i8"),
            ]


def _count_pairs(requests: pa.Table, unigrams: Unigrams) -> pa.Table:
    """Counts of all pairs of one bucket, what its contexts sum up to, and the answers."""
    asked = [
        (r["batch"], *map(_unpacked, r["data"], ("<u8", "<i4", "<u8", "<i8", "<i8")))
        for r in sorted(requests.to_pylist(), key=lambda r: r["batch"])
    ]
    bucket = requests.column("bucket")[0].as_py()
    heads, inverse = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
    context = np.repeat(inverse, np.concatenate([a[2] for a in asked]))
    follower, word_count, own = (np.concatenate([a[i] for a in asked]) for i in (3, 4, 5))
    key = mix64(heads[context] + follower * _ODD)
    order = np.argsort(key, kind="stable")
    new = np.ones(key.size, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    group = np.empty(key.size, np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    total = np.bincount(group, weights=own).astype(np.int64)
    seen = np.flatnonzero(total > 0)
    at, count = context[first[seen]], total[seen]
    by_count = [np.bincount(at[count == r], minlength=heads.size) for r in range(1, DISCOUNTED + 1)]
    occurrences = np.bincount(at, weights=count, minlength=heads.size).astype(np.int64)
    lower = np.bincount(at, weights=unigrams(word_count[first[seen]]), minlength=heads.size)
    sorted_ = np.lexsort((follower[first[seen]], at))
    model = [
        _packed(heads, "<u8", 6),
        _packed(np.bincount(at, minlength=heads.size), "<i4"),
        _packed(follower[first[seen]][sorted_], "<u8", 6),
        _packed(count[sorted_], "<i8"),
    ]
    rows = [("model", -1, bucket, model, _tallied(count))]
    begin = head = 0
    for number, contexts, _, pairs, *_ in asked:
        mine = slice(begin, begin + pairs.size)
        about = inverse[head : head + contexts.size]
        begin, head = begin + pairs.size, head + contexts.size
        # a pair without an answer occurs in the asking batch alone
        whole = total[group[mine]]
        other = np.flatnonzero(whole != own[mine])
        # nor does a context whose occurrences are all in that batch
        here = np.bincount(context[mine], weights=own[mine], minlength=heads.size)
        wider = np.flatnonzero(occurrences[about] != here[about])
        about = about[wider]
        data = [
            _packed(np.diff(other, prepend=0), "<i4"), _packed(whole[other], "<i8"), _packed(np.diff(wider, prepend=0), "<i4"),
            _packed(occurrences[about], "<i8"), _packed(lower[about], "<f8"), *(_packed(f[about], "<i4") for f in by_count),
        ]
        rows.append(("pair", number, bucket, data, None))
    return _answers(rows)


def _scored(batch: _Batch, counts: np.ndarray, pairs: _Pairs, answers: list[dict], unigrams: Unigrams, factor: np.ndarray) -> pa.Table:
    by_bucket = {a["bucket"]: a["data"] for a in answers if a["kind"] == "pair"}
    count = pairs.train.copy()
    n = pairs.contexts.size
    occurrences, lower, taken = np.zeros(n), np.zeros(n), np.zeros(n)
    probability = unigrams(counts)
    for bucket, asked, contexts in pairs.asked:
        steps, whole, wider, occurs, sums, *by_count = map(
            _unpacked, by_bucket[bucket], ("<i4", "<i8", "<i4", "<i8", "<f8", *["<i4"] * DISCOUNTED)
        )
        # what the batch knows itself, unless the answer says more
        seen = asked[pairs.train[asked] > 0]
        own, at = pairs.train[seen], np.searchsorted(contexts, pairs.context[seen])
        parts = [np.bincount(at, weights=w, minlength=contexts.size) for w in (own, probability[pairs.word[seen]])]
        parts += [np.bincount(at[own == r], minlength=contexts.size).astype(float) for r in range(1, DISCOUNTED + 1)]
        for part, told in zip(parts, (occurs, sums, *by_count), strict=True):
            part[np.cumsum(wider)] = told
        count[asked[np.cumsum(steps)]] = whole
        occurrences[contexts] += parts[0]
        lower[contexts] += parts[1]
        for r, many in enumerate(parts[2:], 1):
            taken[contexts] += (1 - factor[r]) * r * many
    extra = np.where((taken <= 0) & (occurrences > 0), 1.0, 0.0)
    size = np.maximum(occurrences + extra, 1)
    # what the seen followers leave, over what the shorter model gives the unseen ones
    backoff = np.where(occurrences > 0, (taken + extra) / size / (1 - lower), 1.0)
    # recursion, shortest history first
    word = probability[batch.codes]
    of_pair = np.where(pairs.of_token >= 0, count[pairs.of_token] if count.size else 0, 0)
    discounted = of_pair * np.where(of_pair <= DISCOUNTED, factor[np.minimum(of_pair, DISCOUNTED)], 1.0)
    p = np.where(of_pair > 0, discounted / size[pairs.before], backoff[pairs.before] * word)
    starts = np.cumsum(batch.sizes) - batch.sizes

    def by_doc(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts)

    ids = pa.array(batch.ids, pa.int64(), mask=batch.null.astype(bool))
    return pa.table(
        {
            "doc_id": ids,
            "held_out": batch.held,
            "n_tokens": batch.sizes,
            "n_known": by_doc((counts[batch.codes] > 0).astype(np.int64)),
            "train_tokens": np.full(batch.ids.size, unigrams.total, np.int64),
            "base_score": by_doc(unigrams.base(counts)[batch.codes]),
            "score": by_doc(np.log10(p)),
        }
    )


def score(docs: DataFrame, held_out: Column, model_path: str | None = None) -> DataFrame:
    """Log10 probability of each text by a Katz backoff model of word pairs.

    In: doc_id, text (other columns are ignored); the model learns from the rows where `held_out`
    is false. Out per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Counts r <= 5 are discounted by Good-Turing factors; each context's backoff weight is
    what its seen followers leave, divided by what the unigrams give the unseen ones, so every
    context sums to one over the vocabulary and one unknown word. The counts are tables
    under `model_path` (default: the checkpoint folder), partitioned by order and kind.

    Neither vocabulary nor pairs are broadcast. Documents are numbered in batches; a batch asks
    each bucket once about each distinct word, then about each distinct pair, and gets the
    counts of the whole corpus back. Words are compared by 64-bit hashes,
    48 bits of them within a bucket. The batches are a bucketed table of the session's catalog.

    Null or empty text: the end token alone. Very long texts: whole. Repeated rows: counted and
    scored each. Null doc_id: stays null, its text learned from if not held out. No training row:
    every probability is the unknown word's, 1. No rows: no rows.
    """
    path = model_path or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/katz-{uuid.uuid4().hex}"
    spark = docs.sparkSession
    # bucketed, so that answers travel to the batches and the batches stay
    name = f"katz_{uuid.uuid4().hex}"
    numbered = docs.select("doc_id", "text", held_out.alias("h")).mapInArrow(_batched, _BATCH)
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered.write.bucketBy(n_files, "batch").option("path", f"{path}/{name}").saveAsTable(name)
    batches = spark.table(name)
    n_batches, train_docs, tokens = batches.agg(
        F.count("*"), F.coalesce(F.sum("n_train_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))
    ).first()
    word_buckets = max(-(-n_batches // 4), 1)
    pair_buckets = max(-(-tokens // (2 * BUCKET_ROWS)), 1)

    def ask_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for i in range(row.num_rows):
                batch = _Batch(pa.Table.from_batches([row.slice(i, 1)]))
                order, cuts = batch.word_order(word_buckets)
                data = [[_packed(v[order[s:e]], k) for v, k in ((batch.words, "<u8"), (batch.train, "<i8"))] for _, s, e in cuts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in cuts], pa.int64()),
                        pa.array([batch.number] * len(cuts), pa.int64()),
                        pa.array(data, pa.list_(pa.binary())),
                    ],
                    ["bucket", "batch", "data"],
                )

    def count_words(requests: pa.Table) -> pa.Table:
        asked = [(r["batch"], *map(_unpacked, r["data"], ("<u8", "<i8"))) for r in requests.to_pylist()]
        bucket = requests.column("bucket")[0].as_py()
        found, inverse = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([a[2] for a in asked])).astype(np.int64)
        seen = total > 0
        rows = [("model", -1, bucket, [_packed(found[seen], "<u8"), _packed(total[seen], "<i8")], _tallied(total[seen]))]
        begin = 0
        for number, mine, _ in asked:
            rows.append(("word", number, bucket, [_packed(total[inverse[begin : begin + mine.size]], "<i8")], None))
            begin += mine.size
        return _answers(rows)

    asked = batches.select("batch", "data", "n_train_docs", "n_tokens").mapInArrow(ask_words, "bucket long, batch long, data array<binary>")
    asked.groupBy("bucket").applyInArrow(count_words, _ANSWER).write.partitionBy("kind").parquet(f"{path}/order=1")
    unigram_answers = spark.read.schema(_ANSWER).parquet(f"{path}/order=1")
    unigrams = Unigrams(_summed(unigram_answers))

    def ask_pairs(batch: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if batch.num_rows:
            one = _Batch(batch)
            pairs = _Pairs(one, one.counted(answers.to_pylist(), word_buckets), train_docs, pair_buckets)
            rows = list(pairs.requests(one.number))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()))
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "batch", "data"), columns, kinds, strict=True)})

    word_answers = unigram_answers.where("kind = 'word'").select("batch", "kind", "bucket", "data")
    asked = (
        batches.groupBy("batch").cogroup(word_answers.groupBy("batch")).applyInArrow(ask_pairs, "bucket long, batch long, data array<binary>")
    )
    counted = asked.groupBy("bucket").applyInArrow(lambda t: _count_pairs(t, unigrams), _ANSWER)
    counted.write.partitionBy("kind").parquet(f"{path}/order=2")
    pair_answers = spark.read.schema(_ANSWER).parquet(f"{path}/order=2")
    factor = discounts(_summed(pair_answers))

    def evaluate(batch: pa.Table, answers: pa.Table) -> pa.Table:
        got = answers.to_pylist()
        one = _Batch(batch)
        counts = one.counted(got, word_buckets)
        pairs = _Pairs(one, counts, train_docs, pair_buckets)
        return _scored(one, counts, pairs, got, unigrams, factor)

    answers = word_answers.union(pair_answers.where("kind = 'pair'").select("batch", "kind", "bucket", "data"))
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        evaluate,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _summed(answers: DataFrame) -> list[int]:
    """Sums over the buckets of what `_tallied` says."""
    sums = [F.sum(F.col("stats")[i]) for i in range(DISCOUNTED + 3)]
    return [int(v or 0) for v in answers.where("kind = 'model'").agg(*sums).first()]


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 5 == 1

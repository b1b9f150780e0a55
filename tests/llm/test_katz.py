import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalograft.llm import katz


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def model(texts):
    """Probability of a word after another, by definition over plain dictionaries."""
    one, two = Counter(), Counter()
    for found in texts:
        one.update(found)
        two.update(zip(["<s>", *found[:-1]], found, strict=True))

    def tally(counts):
        return [sum(v == r for v in counts.values()) for r in range(1, 7)]

    d1, d2 = katz.discounts(tally(one)), katz.discounts(tally(two))
    total = sum(one.values())

    def cut(c, d):
        return c * (d[c] if c <= 5 else 1)

    left = total - sum(cut(c, d1) for c in one.values())
    extra = 0 if left > 1e-12 else 1
    size, unknown = total + extra, (left + extra) / (total + extra)

    def p1(w):
        return cut(one[w], d1) / size if one[w] else unknown

    after = defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c
    weight = {}
    for h, f in after.items():
        seen = sum(f.values())
        kept = seen - sum(cut(c, d2) for c in f.values())
        more = 0 if kept > 1e-12 else 1
        weight[h] = seen + more, (kept + more) / (seen + more) / (1 - sum(map(p1, f)))

    def p2(h, w):
        if h not in weight:
            return p1(w)
        size, backoff = weight[h]
        return cut(after[h][w], d2) / size if w in after[h] else backoff * p1(w)

    return one, p1, p2, weight


@pytest.mark.parametrize("rows", ["documents", "hard"])
def test_scores_equal_the_definition(request, rows, spark, monkeypatch, tmp_path):
    # several batches and buckets even on small tables
    docs = request.getfixturevalue(rows).repartition(3)
    monkeypatch.setattr(katz, "BUCKET_ROWS", 3_000)
    held = katz.held_out(F.col("doc_id"))
    got = katz.score(docs, held, str(tmp_path / "model")).collect()
    found = [(r["doc_id"], tokens(r["text"])) for r in docs.select("doc_id", "text").collect()]

    def out(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1

    one, _, p2, _ = model([t for d, t in found if not out(d)])
    total, distinct = sum(one.values()), len(one)
    wanted = sorted(
        (
            d is None, d or 0, len(t), sum(one[w] > 0 for w in t),
            round(sum(math.log10((one[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), 5),
            round(sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True)), 5),
        )
        for d, t in found
    )
    rows = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in got
    )
    assert [w[:4] for w in wanted] == [r[:4] for r in rows]
    for w, r in zip(wanted, rows, strict=True):
        assert r[4:] == pytest.approx(w[4:], rel=1e-7, abs=2e-5)
    assert {r["train_tokens"] for r in got} == {total}
    kinds = {r[0] for r in spark.read.parquet(str(tmp_path / "model/order=2")).select("kind").distinct().collect()}
    assert kinds == {"model", "pair"}


def test_spread_contexts_are_asked_in_all_their_buckets(documents, monkeypatch):
    found = [tokens(r["text"])[:-1] for r in documents.limit(40).collect()]
    rows = [(i, [w.encode() for w in t]) for i, t in enumerate(found)]
    whole = {}
    for limit in (10**9, 50):
        monkeypatch.setattr(katz, "CONTEXT_ROWS", limit)
        tables = []
        for part in (rows[:20], rows[20:]):
            record = katz.pa.RecordBatch.from_arrays(
                [katz.pa.array([i for i, _ in part]), katz.pa.array([b" ".join(w).decode() for _, w in part]), katz.pa.array([i % 5 == 1 for i, _ in part])],
                ["doc_id", "text", "h"],
            )
            monkeypatch.setattr(katz, "TaskContext", type("T", (), {"get": staticmethod(lambda n=len(tables): type("C", (), {"partitionId": lambda self: n})())}))
            tables.append(katz._Batch(katz.pa.Table.from_batches(list(katz._batched(iter([record]))))))
        total = Counter()
        for b in tables:
            for w, n in zip(b.words.tolist(), b.train.tolist(), strict=True):
                total[w] += n
        unigrams = katz.Unigrams(katz._tallied(katz.np.array(list(total.values()))))
        asked, pairs = {}, []
        for b in tables:
            counts = katz.np.array([total[w] for w in b.words.tolist()])
            pairs.append((b, counts, katz._Pairs(b, counts, sum(i % 5 != 1 for i, _ in rows), 7)))
            for bucket, number, data in pairs[-1][2].requests(b.number):
                asked.setdefault(bucket, []).append({"bucket": bucket, "batch": number, "data": data})
        answers = [r for a in asked.values() for r in katz._count_pairs(katz.pa.Table.from_pylist(a), unigrams).to_pylist()]
        factor = katz.discounts([sum(x) for x in zip(*(r["stats"] for r in answers if r["kind"] == "model"), strict=True)])
        for b, counts, p in pairs:
            mine = [r for r in answers if r["batch"] == b.number]
            for r in katz._scored(b, counts, p, mine, unigrams, factor).to_pylist():
                assert whole.setdefault(r["doc_id"], r["score"]) == pytest.approx(r["score"])


def test_every_context_sums_to_one(documents):
    texts = [tokens(r["text"]) for r in documents.limit(20).collect()]
    one, p1, p2, weight = model(texts)
    for h in list(weight)[:10]:
        assert sum(p2(h, w) for w in one) + p2(h, object()) == pytest.approx(1)


def test_beats_the_base_on_held_out_texts(documents):
    held = katz.score(documents, katz.held_out(F.col("doc_id"))).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_empty_table_and_nothing_to_learn_from(make):
    assert katz.score(make().where("doc_id = 0"), F.lit(False)).count() == 0
    row = katz.score(make((1, "a b")), F.lit(True)).first()
    assert (row["score"], row["n_known"], row["train_tokens"]) == (0.0, 0, 0)

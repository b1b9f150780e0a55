import numpy as np
import pytest
from pyspark.sql import functions as F

from catalograft.llm import langid


@pytest.fixture(scope="module")
def net(documents):
    return langid.fit(documents.where(~langid.held_out(documents["doc_id"])))


def test_held_out_accuracy(spark, net):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = langid.identify(docs, net).where(langid.held_out(F.col("doc_id")))
    right, total = judged.where("lang = lang_pred").count(), judged.where("lang is not null").count()
    assert total > 200 and right >= 0.97 * total


def test_hard_rows(hard, net):
    rows = langid.identify(hard, net).collect()
    assert len(rows) == hard.count() and set(hard.columns) < set(rows[0].asDict())
    for r in rows:
        assert 0 <= r["lang_score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))


def test_nothing_to_learn_from_and_empty(make, hard):
    assert langid.fit(hard) is None
    assert {r["lang_pred"] for r in langid.identify(hard, None).collect()} == {"und"}
    assert langid.identify(make().where("doc_id = 0"), None).count() == 0
    one = langid.fit(make((1, "only one language", "xx"), (2, None, "yy"), (3, "   ", "zz")))
    assert one.languages == ["xx"] or set(one.languages) == {"xx", "zz"}


def test_lang_source_and_id_are_no_inputs(make, net):
    text = "Les mots de la langue et des autres"
    rows = langid.identify(make((1, text, "en", "src1"), (2, text, "de", "src2"), (3, text, None, None)), net).collect()
    assert len({(r["lang_pred"], r["lang_score"]) for r in rows}) == 1


def test_every_position_is_labelled_and_pooled(net):
    text = "Le la thorin " + "w" * 70
    labels = langid.label_positions(net, text)
    assert [len(p) for p, _ in labels] == [3, 3, 7, 32, 32, 7] and all(len(p) == len(names) for p, names in labels)
    mean = net.pooled(text.lower().encode().split()).sum(axis=0) / sum(len(p) for p, _ in labels)
    assert mean.sum() == pytest.approx(1, abs=1e-4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.Network(
        ["a", "b"], langid.Direction.fresh(rng, langid.HIDDEN), langid.Direction.fresh(rng, langid.HIDDEN),
        rng.normal(0, 0.3, (2 * langid.HIDDEN + 1, 2)).astype(np.float32),
    )
    params = [net.forward.by_byte, net.forward.inner, net.backward.by_byte, net.backward.inner, net.out]
    data, label = rng.integers(97, 101, (5, 6)).astype(np.uint8), np.array([0, 1, 1, 0, 1])

    def loss():
        return -np.log(net.positions(data)[:, np.arange(5), label].astype(np.float64)).mean()

    for p, g in zip(params, net._gradients(data, label), strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape) if p.shape[0] != 256 else (int(rng.integers(97, 101)), int(rng.integers(p.shape[1])))
            before = p[at]
            p[at] = before + 1e-2
            up = loss()
            p[at] = before - 1e-2
            down = loss()
            p[at] = before
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_share_of_learned_letters(make):
    net = langid.Network(["a", "b"], None, None, None, "abcABCé\\]^-")
    net.letters = "abcABCé"
    texts = ["", None, "12 !", "abc xyz", "abc xyzw", "ABCé", "жжж abc", "жжж ab", "\U00010400é", "xyz"]
    docs = make(*enumerate(texts))
    kept = {r["doc_id"] for r in docs.where(langid.of_learned_letters(docs["text"], net)).collect()}

    def by_hand(text):
        letters = [c for c in text if c.isalpha()]
        return 2 * sum(c in net.letters for c in letters) >= len(letters)

    assert kept == {i for i, t in enumerate(texts) if t is not None and by_hand(t)}
    none = docs.where(langid.of_learned_letters(docs["text"], None)).collect()
    assert {r["doc_id"] for r in none} == {0, 2}

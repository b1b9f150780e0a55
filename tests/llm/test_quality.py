import numpy as np

from catalograft.llm import quality as q
from catalograft.llm import queries


def test_statistics_by_hand():
    f = dict(zip(q.FEATURES, q.statistics("Go go go!\nGO FAR.\n\nGo go go!\n"), strict=True))
    assert (f["words"], f["lines"], f["longest_word"]) == (8, 3, 4) and f["distinct"] == 3 / 8
    assert f["repeated"] == 2 / 7  # "go!" is another word than "go"
    assert f["repeated_lines"] == 1 - 2 / 3 and f["ended_lines"] == 1 and f["shouted"] == 2 / 8
    assert q.statistics(None) == q.statistics("") == [0.0] * len(q.FEATURES)
    assert q.statistics(" \t\n")[1:] == [0.0] * (len(q.FEATURES) - 1)
    assert all(np.isfinite(q.statistics(t)).all() for t in ("x", "é", "\x00", "x" * 100_000, "a b " * 100_000, "\x1c"))


def test_worst_window():
    flags = np.zeros(200, bool)
    flags[100 : 100 + q.WINDOW] = True
    assert q._worst(flags) == 1.0 and q._worst(flags[:50]) == 0.0 and q._worst(flags[100:104]) == 1.0 and q._worst(flags[:0]) == 0.0


def one_by_one(model, row):
    total = model.base
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 if row[model.feature[t, node]] <= model.border[t, node] else 2 * node + 2
        total += model.value[t, node - model.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def best_split(x, g, h):
    best = (0.0, None)
    for f in range(x.shape[1]):
        for b in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= b
            if low.sum() >= q.LEAF_ROWS and (~low).sum() >= q.LEAF_ROWS:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + q.RIDGE) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + q.RIDGE)
                best = max(best, (gain, (f, tuple(low))), key=lambda v: v[0])
    return best


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (300, 4)).astype(float)
    y = ((x[:, 1] > 9) ^ (x[:, 3] > 14)).astype(float)
    model = q.Trees.train(x, y)
    got = model.score(x)
    np.testing.assert_allclose(got, [one_by_one(model, r) for r in x], rtol=1e-12)
    assert ((got > 0.5) == y).all()
    # the first question is the one with the largest gain of all
    p = 1 / (1 + np.exp(-model.base))
    _, (feature, low) = best_split(x, p - y, np.full(len(y), p * (1 - p)))
    assert model.feature[0, 0] == feature and (x[:, feature] <= model.border[0, 0]).tolist() == list(low)
    # the loss falls from tree to tree
    losses = []
    for trees in (1, 5, 20):
        s = q.Trees.train(x, y, trees=trees).score(x)
        losses.append(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())
    assert losses == sorted(losses, reverse=True)


def test_nothing_or_one_kind_to_learn_from():
    none = q.Trees.train(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.zeros((2, 3))).tolist() == [0.5, 0.5] and none.score(np.zeros((0, 3))).size == 0
    assert (q.Trees.train(np.zeros((9, 3)), np.ones(9)).score(np.zeros((1, 3))) > 0.9).all()
    same = q.Trees.train(np.ones((40, 3)), np.arange(40) % 2)  # no feature differs
    np.testing.assert_allclose(same.score(np.ones((1, 3))), 0.5)


def test_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 0), (5, 1), (8, 1), (None, 1), (2, None), (3, 7), (1, 1)], "doc_id long, quality int")
    model = q.fit(hard, labels)
    found = q.judge(hard.withColumn("quality_score", hard["doc_id"]), model)
    assert found.columns == [*hard.columns, "quality_score"] and found.count() == hard.count()
    assert all(0 <= r["quality_score"] <= 1 for r in found.collect())
    by_text = {}
    for r in found.collect():
        assert by_text.setdefault(r["text"] or "", r["quality_score"]) == r["quality_score"]
    assert q.judge(hard.limit(0), model).count() == 0
    assert q.fit(hard, labels.limit(0)).score(np.zeros((1, len(q.FEATURES)))).tolist() == [0.5]


def test_sample_is_bounded(spark, make):
    docs = make(*[(i, f"text number {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    seen = []
    q_train, q.Trees.train = q.Trees.train, classmethod(lambda cls, x, y: seen.append(len(y)))
    try:
        q.fit(docs, labels, rows=50)
    finally:
        q.Trees.train = q_train
    assert 20 <= seen[0] <= 100


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = queries.op12_quality(spark, sf_dir)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert right >= 0.95 and np.mean([g > b for g in good for b in bad]) >= 0.98
    assert found.count() == 1000

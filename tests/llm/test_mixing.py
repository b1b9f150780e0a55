import pytest

from catalograft.llm import mixing


def targets(sizes):
    """Water filling by bisection of the level."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget = 1.5 * sum(sizes.values())
    low, high = 0.0, 2.0 * budget + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < budget:
            low = mid
        else:
            high = mid
    return {s: min(2 * sizes[s], high * weight[s]) for s in names}


def check(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for text, source in rows:
        n = len((text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")) - (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ").count("")
        sizes[source] = sizes.get(source, 0) + n
    wanted = targets(sizes)
    return got, sizes, wanted


def test_targets_and_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["text"], r["source"]) for r in docs.collect()]
    got, sizes, wanted = check(docs, rows)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in taken)


def test_epochs_come_first_and_reruns_agree(make, monkeypatch):
    rows = [(i, "w " * (i % 7 + 1), None, "abc"[i % 3] if i % 2 else "a") for i in range(400)]
    docs = make(*rows)
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    for source in "abc":
        mine = [got[i] for i, _, _, s in rows if s == source]
        epochs = int(mine[0]["target"] // mine[0]["source_size"]) if mine[0]["source_size"] else 0
        assert all(epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"] for r in mine)
        assert sum(0 < r["taken"] - epochs * r["size"] < r["size"] for r in mine) <= 1
    # neither partitioning nor the pieces a source is sorted in change the result
    monkeypatch.setattr(mixing, "PIECE_ROWS", 7)
    again = {r["doc_id"]: r for r in mixing.mix_sources(docs.repartition(9)).collect()}
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in again.items()}


def test_quality_raises_the_chance(make):
    good, odd = "seven letters " * 40, "a " * 80
    rows = [(i, good if i % 2 else odd, None, "s") for i in range(600)] + [(i, "filler " * 400, None, "t") for i in range(600, 700)]
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_sources(make(*rows)).collect()}
    more = [sum(taken[i][0] for i in range(600) if i % 2 == k) for k in (0, 1)]
    assert more[1] > more[0]


def test_hard_rows(hard, hard_rows, make):
    got, _, _ = check(hard, [(t, None) for _, t in hard_rows])
    assert {r["taken"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.mix_sources(make().where("doc_id = 0")).count() == 0
    assert {(r["target"], r["taken"]) for r in mixing.mix_sources(make((1, None), (2, ""))).collect()} == {(0.0, 0)}


def test_rows_of_the_mix(make):
    docs = make((1, "a b  c\nd", None, "x"), (2, "e f", None, "x"), (2, "e f", None, "x"), (3, None, None, "y"))
    mixed = mixing.mix_sources(docs)
    rows = mixing.repeated(docs, mixed)
    assert rows.columns == docs.columns
    words = sum(len(r["text"].split()) for r in rows.collect())
    assert words == mixed.groupBy().sum("taken").first()[0]
    for r in rows.collect():
        assert {1: "a b  c\nd", 2: "e f"}[r["doc_id"]].startswith(r["text"])

import numpy as np
import pytest

from catalograft.llm import ann, embedding_dedup
from catalograft.llm.common import local_components
from catalograft.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, class int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3) for i, v in rows], SCHEMA)


def some(n=300, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(40, 140):  # near copies, chains among them
        x[i] = x[i - 1 if i % 3 else rng.integers(40)] + rng.normal(scale=0.12, size=dim)
    x[200:230] = x[7]
    return [(int(i) * 3 + 1, v) for i, v in enumerate(x)]


ODD = [(9_000, None), (9_001, [0.0] * 12), (9_002, [float("nan")] + [1.0] * 11), (9_003, [float("inf")] + [1.0] * 11), (9_004, [None] + [1.0] * 11), (9_005, [])]


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def expected(rows, least=0.95):
    ids = [i for i, v in rows if good(v)]
    x = np.array([v for _, v in rows if good(v)], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    a, b = np.nonzero(near)
    ends = np.array(ids)
    nodes, least_id = local_components(ends[a], ends[b])
    reach = dict(zip(nodes.tolist(), least_id.tolist(), strict=True))
    links = dict(zip(ids, (near.sum(axis=1) - 1).tolist(), strict=True))
    return sorted((i, links.get(i, 0), reach.get(i, i)) for i, _ in rows)


@pytest.mark.parametrize("tile_rows", [4_096, 30])
def test_links_equal_all_pairs(spark, tile_rows):
    rows = some() + ODD
    got = embedding_dedup.near_vectors(table(spark, rows), tile_rows=tile_rows).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == expected(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_of_two_lengths_null_ids_and_repeats(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [2, 0.1]), (3, [1, 0, 0]), (None, [1, 0]), (None, [0, 1])]
    got = [tuple(r) for r in embedding_dedup.near_vectors(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (None, 3, 1, False), (None, 0, None, False)], key=str
    )
    assert embedding_dedup.near_vectors(table(spark, [])).count() == 0
    assert embedding_dedup.near_vectors(table(spark, ODD)).count() == len(ODD)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(0, 200, 1)] + [(500, i) for i in range(600, 700)] + [(900, 900), (901, 902), (902, 901)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(600, 700)} == {500} and got[902] == 901
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, queries, k):
    ids = np.array([i for i, v in rows if good(v)])
    x = np.array([v for _, v in rows if good(v)], np.float64)
    out = {}
    for q, v in queries:
        if good(v):
            d = np.sqrt(((x - np.array(v, np.float64)) ** 2).sum(axis=1))
            order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
            out[q] = [(int(ids[i]), d[i]) for i in order]
    return out


def test_search_recall_scores_and_ranks(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3_000, 16)).astype(np.float32))] + [(9_000, None), (9_100, [0.0] * 16)]
    queries = [r for r in rows if r[0] % 100 == 0]
    report = {}
    got = ann.nearest(table(spark, rows), table(spark, queries), leaf_rows=32, report=report).collect()
    truth = brute(rows, queries, 10)
    assert report["leaves"] > 20 and report["visits"][0] < report["leaves"] and report["levels"] == 1 and report["recall"] >= ann.RECALL
    hits = 0
    for q, wanted in truth.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        hits += len({m[1] for m in mine} & {w[0] for w in wanted})
        exact = dict(brute(rows, [(q, dict(rows)[q])], 3_000)[q])
        assert all(exact[m[1]] == m[2] for m in mine)
    assert hits >= 0.9 * 10 * len(truth) and {r["query_id"] for r in got} == set(truth)


def test_search_in_trees_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    # a hot spot of half of all rows, one vector many times, and the rest wide apart
    x = np.concatenate([rng.normal(size=(900, 6)), 4 + rng.normal(scale=0.02, size=(1_200, 6)), np.full((300, 6), -7.0)])
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(x)]
    queries = [r for r in rows if r[0] % 20 == 0] + [(9_001, np.full(6, 0.5, np.float32))]
    monkeypatch.setattr(ann, "PART_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "SPLIT", 4)
    report = {}
    got = ann.nearest(table(spark, rows), table(spark, queries), leaf_rows=8, tree_leaves=6, report=report).collect()
    assert report["levels"] >= 3 and report["recall"] >= ann.RECALL
    truth = brute(rows, queries, 10)
    exact = {q: dict(brute(rows, [(q, v)], 3_000)[q]) for q, v in queries}
    hits = 0
    for q, wanted in truth.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and len({m[1] for m in mine}) == 10
        assert all(exact[q][m[1]] == m[2] for m in mine)
        # equally near rows count alike
        hits += sum(m[2] <= wanted[-1][1] for m in mine)
    assert hits >= 0.9 * 10 * len(truth)


def test_blocks_of_ties_keep_the_nearest():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 4)) * 3) / 3 * 1000
    ids, kept = rng.permutation(900), ann._Kept(10)
    for s in range(0, 900, 30):
        kept.add_block(ids[s : s + 30], x[s : s + 30], ids[:50].tolist(), x[:50])
    for own, v in zip(ids[:50].tolist(), x[:50], strict=True):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        wanted = [i for i in np.lexsort((ids, d)) if ids[i] != own][:10]
        assert kept.found[own][0].tolist() == ids[wanted].tolist() and kept.found[own][1].tolist() == d[wanted].tolist()


def test_visits_are_widened_level_by_level():
    assert ann._widened([[1, 1, 2, 9]], 0.75, 1) == [2]
    assert ann._widened([[1, 1, 1, 1], [1, 2, 3, 4]], 1.0, 2) == [1, 4]
    assert ann._widened([[]], 0.96, 3) == [1, 1, 1]


def test_search_ties_copies_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 400)] + [(1_000, [1.0, 2.5])]
    got = ann.nearest(table(spark, rows), table(spark, rows[:1] + rows[-1:])).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == list(range(1, 11))
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1_000] == list(range(10))
    few = ann.nearest(table(spark, rows[:3]), table(spark, rows[:1])).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in few] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert ann.nearest(table(spark, []), table(spark, rows)).count() == 0
    assert ann.nearest(table(spark, rows), table(spark, [])).count() == 0


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2_000, 5))
    tree = ann.Tree.fit(x, 40)
    order = list(tree.visit(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.leaf_of(x[:1])[0]


@pytest.mark.parametrize("share_bytes", [1 << 27, 20_000])
def test_routing_sends_a_vector_once_to_a_part(spark, monkeypatch, share_bytes):
    # wide apart: most leaves are visited by every query
    rng = np.random.default_rng(12)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(2_400, 24)).astype(np.float32))]
    queries = rows[::4]
    sizes, settle = [], ann.settle

    def settled(df):
        out = settle(df)
        if "queries" in out.columns:
            sizes.append(sum(len(r["queries"]) + len(r["q"] or b"") for r in out.select("queries", "q").collect()))
        return out

    monkeypatch.setattr(ann, "settle", settled)
    monkeypatch.setattr(ann, "SHARE_BYTES", share_bytes)
    report = {}
    got = ann.nearest(table(spark, rows), table(spark, queries), leaf_rows=32, report=report).collect()
    visits = report["visits"][0]
    assert report["leaves"] > 60 and visits > report["leaves"] // 3
    # ids of visits and one vector each; not a vector a visit
    assert sizes and max(sizes) <= len(queries) * (8 * visits + 8 + 4 * 24)
    truth = brute(rows, queries, 10)
    hits = sum(r["score"] <= truth[r["query_id"]][-1][1] for r in got)
    assert len(got) == 10 * len(queries) and hits >= 0.9 * len(got)
    assert all(r["score"] == np.sqrt(((np.float64(rows[r["vec_id"]][1]) - rows[r["query_id"]][1]) ** 2).sum()) for r in got[::50])


def test_calibration_takes_one_vector_of_a_true_neighbour(spark):
    # one id many times: its copies do not all reach the driver
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(7, [7.0, 1.0])] * 500
    seen, frame = [], type(spark.range(0))
    collect = frame.collect

    def counted(self):
        out = collect(self)
        seen.append(len(out))
        return out

    try:
        frame.collect = counted
        ann.nearest(table(spark, rows), table(spark, rows[:20])).count()
    finally:
        frame.collect = collect
    assert max(seen) <= 20 * 10

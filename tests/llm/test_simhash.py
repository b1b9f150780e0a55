import itertools
import re

import numpy as np
import xxhash

from catalograft.llm import simhash
from catalograft.llm.common import local_components


def by_definition(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass"), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, most=3):
    u, inverse = np.unique(np.array(fps, np.uint64), return_inverse=True)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None]) <= most)
    return u, inverse, local_components(a, b)[1]


def test_fingerprints_equal_the_definition(hard_rows, documents):
    for _, text in hard_rows:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == by_definition(text)
    for r in documents.limit(20).collect():
        assert simhash.fingerprint(r["text"]) & (1 << 64) - 1 == by_definition(r["text"])


def test_the_code_is_perfect_and_anchors_are_complete():
    golay = simhash._golay(3)
    assert len(golay.code) == 4096 and len(set(golay.leaders.tolist())) == 2048
    words = np.random.default_rng(0).integers(0, 1 << 23, 50, dtype=np.uint32)
    apart = np.bitwise_count(golay.code[:, None] ^ words[None])
    assert (golay.home(words) == apart.argmin(axis=0)).all() and apart.min(axis=0).max() <= 3
    for e in range(4):
        index, anchor, need = golay.around(words, np.full(50, e))
        got = {(int(i), int(a)): int(n) for i, a, n in zip(index, anchor, need)}
        assert got == {(i, a): max(0, int(apart[a, i]) - 3) for i in range(50) for a in np.flatnonzero(apart[:, i] <= 3 + e)}


def planted(seed=2):
    """Fingerprints with neighbours at every distance up to 5 and a dense ball."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    out = list(base.tolist())
    for f in base.tolist():
        for d in (1, 2, 3, 4, 5):
            out.append(f ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    out += [int(base[0]) ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(64), 2)][:900]
    return out


def test_links_equal_all_pairs(spark, monkeypatch):
    for cells in ((4_096, 400_000), (50, 2_000)):  # whole anchors, and anchors cut into grids
        monkeypatch.setattr(simhash, "CELL_HOMES", cells[0])
        monkeypatch.setattr(simhash, "CELL_COPIES", cells[1])
        fps = planted()
        u, _, label = groups(fps)
        rows = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in u], "fp long").repartition(3)
        got = simhash.near_pairs(rows).toPandas()
        a, b = (got[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        assert (np.bitwise_count(a ^ b) <= 64).all()
        at = {int(f): i for i, f in enumerate(u)}
        nodes = np.arange(len(u))
        ends = local_components(
            np.concatenate([[at[int(x)] for x in a], nodes]), np.concatenate([[at[int(x)] for x in b], nodes])
        )[1]
        assert (ends == label).all()


def test_documents_ids_and_repeats(make, hard, hard_rows, documents):
    text = " ".join(f"word{i}" for i in range(400))
    near = text.replace("word200", "other")
    rows = [*hard_rows, (41, text), (42, near), (43, text), (40, "unlike " * 30)]
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(make(*rows)).collect()]
    u, inverse, label = groups([by_definition(t) for _, t in rows])
    least = {}
    for (d, _), i in zip(rows, inverse, strict=True):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    wanted = [(d, int(u[i]), least.get(label[i])) for (d, _), i in zip(rows, inverse, strict=True)]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert simhash.near_duplicates(make().where("doc_id = 0")).count() == 0


def test_one_of_each_group_stays(make, hard_rows):
    docs = make(*hard_rows, (None, "only null ids here"), (None, "only null ids here"))
    found = simhash.near_duplicates(docs)
    kept = simhash.one_of_each(docs, found)
    assert kept.count() == found.select("component").distinct().count() and kept.columns == docs.columns

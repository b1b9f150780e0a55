import numpy as np
import pytest

from catalograft.llm import whitening as w


def frame(spark, rows):
    full = [(i, v, None, "x", 1) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, component string, n int")


def by_hand(vectors, components=32):
    """Exact numbers, eigenvectors of the dense covariance."""
    x = [[int(np.floor(float(c) * 64)) + 1_000_000 for c in np.float32(v)] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    away = [[n * c - s for c, s in zip(v, sums)] for v in x]
    centred = np.array(away, dtype=float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [sum(c * c for c in v) for v in away], centred, values, vectors, np.trace(cov)


@pytest.mark.parametrize("dim, n", [(40, 300), (6, 50)])
def test_equals_dense_eigenvectors(spark, dim, n):
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(n, dim)) * np.linspace(3, 0.5, dim) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    got = w.whiten(frame(spark, rows).repartition(5)).collect()
    deviation, centred, values, basis, trace = by_hand(vectors)
    k = min(dim, 32)
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1))
    white = np.zeros((n, k))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] <= 1e-10
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-10)
    expected = centred @ basis / np.sqrt(values)
    sign = np.sign((expected * white).sum(axis=0))
    np.testing.assert_allclose(white * sign, expected, atol=1e-7)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [0.0, 0.0, 0.0]), (None, [0.5, -1.0, 0.25]), (3, [-3.0, 1.0, 0.0])]
    odd = [(4, None), (5, []), (6, [1.0, None, 0.0]), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1e30, 0.0, 0.0]), (10, [1.0, 2.0])]
    got = w.whiten(frame(spark, good + odd)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i, _ in good for c in (1, 2, 3))
    deviation = by_hand([v for _, v in good])[0]
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, d) for (i, _), d in zip(good, deviation)}
    assert all(r["n"] == 5 and r["identity_error"] <= 1e-10 for r in got)


def test_no_variance(spark):
    assert w.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert w.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert w.whiten(frame(spark, [(1, None)])).count() == 0
    # one direction only
    got = w.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0])])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 12), round(r["explained"], 12)) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_beyond_64_bits():
    x = np.array([[1 << 40, 5], [0, 7]], np.int64)
    away = w._centred(x, 1 << 30, np.array([1 << 69, 3], object))
    assert away.tolist() == [[(1 << 70) - (1 << 69), 5 * (1 << 30) - 3], [-(1 << 69), 7 * (1 << 30) - 3]]
    assert w._squares(away, np.array([True, True]))[1] == (1 << 138) + (7 * (1 << 30) - 3) ** 2


@pytest.mark.parametrize("dim, wanted, low", [(300, 32, 1e-3), (120, 8, 1e-6), (64, 32, 0.5)])
def test_leading_pairs(dim, wanted, low):
    rng = np.random.default_rng(dim)
    basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    values = np.geomspace(1, low, dim)
    matrix = basis * values @ basis.T
    columns = []

    def product(block):
        columns.append(block.shape[1])
        return matrix @ block

    found, vectors = w.leading(product, dim, wanted)
    np.testing.assert_allclose(found, values[:wanted], rtol=1e-11)
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() <= 1e-12
    assert len(columns) < 150


def test_repeated_and_zero_eigenvalues():
    matrix = np.diag([2.0, 2.0, 2.0, 1.0, 1.0] + [0.0] * 45)
    found, vectors = w.leading(lambda b: matrix @ b, 50, 8)
    np.testing.assert_allclose(found, [2, 2, 2, 1, 1, 0, 0, 0], atol=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() <= 1e-12


def test_a_correction_solves_its_equation():
    rng = np.random.default_rng(4)
    dim = 9
    matrix = rng.normal(size=(dim, dim))
    matrix = matrix + matrix.T
    kept = np.linalg.qr(rng.normal(size=(dim, 2)))[0]
    right = rng.normal(size=(dim, 3))
    right -= kept @ (kept.T @ right)
    shift = np.array([0.3, -1.0, 5.0])
    apart = np.eye(dim) - kept @ kept.T
    share, w.INNER_SHARE = w.INNER_SHARE, 1e-12
    try:
        x = w._corrections(lambda b: matrix @ b, kept, shift, right)
    finally:
        w.INNER_SHARE = share
    for j in range(3):
        op = apart @ (matrix - shift[j] * np.eye(dim)) @ apart
        np.testing.assert_allclose(op @ x[:, j], -right[:, j], atol=1e-8)

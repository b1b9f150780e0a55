"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalograft.session import settle

COMPONENTS = 32
#: Components become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: A component beyond this cannot be such a number; its vector is left out like one with an infinite component.
LARGEST = 2.0**40
#: Inner steps of a correction, and the share of its residual at which it ends earlier.
INNER, INNER_SHARE = 8, 0.05
#: Residuals end at so many roundings of the largest eigenvalue; so do eigenvalues that are none.
ROUNDINGS = 256
MOST_ROUNDS = 200
#: Partial results are summed in so many groups of tasks before they reach the driver.
GROUPS = 16

Product = Callable[[np.ndarray], np.ndarray]


def _orthogonal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` adds to orthonormal bases; may have fewer columns."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        for basis in bases:
            new = new - basis @ (basis.T @ new)
        left, strength, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, strength > 1e-10 * max(strength.max(initial=0), 1e-300)] if new.size else new
    return new


def _corrections(product: Product, kept: np.ndarray, shift: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """MINRES on (I - QQ')(A - shift)(I - QQ') t = -residual, Q = `kept`; all columns in step.

    A step costs one product for all columns; each has a shift and scalars of its own. A column that
    breaks down or is good enough keeps what it has.
    """

    def apart(x: np.ndarray) -> np.ndarray:
        return x - kept @ (kept.T @ x)

    right = apart(-residual)
    begin = np.linalg.norm(right, axis=0)
    beta, eta = begin.copy(), begin.copy()
    v = right / np.where(beta > 0, beta, 1)
    v_old, w, w_old, x = (np.zeros_like(right) for _ in range(4))
    cos = cos_old = np.ones(beta.size)
    sin = sin_old = np.zeros(beta.size)
    on = beta > 0
    for _ in range(INNER):
        if not on.any():
            break
        image = apart(product(v) - v * shift)
        alpha = (v * image).sum(axis=0)
        image = image - v * alpha - v_old * beta
        beta_new = np.linalg.norm(image, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        rho = np.hypot(delta, beta_new)
        on &= rho > 0
        safe = np.where(rho > 0, rho, 1)
        w, w_old = (v - w_old * (sin_old * beta) - w * (sin * alpha + cos_old * cos * beta)) / safe, w
        cos_old, sin_old, cos, sin = cos, sin, delta / safe, beta_new / safe
        x = x + np.where(on, cos * eta, 0) * w
        eta = -sin * eta
        on &= (np.abs(eta) > INNER_SHARE * begin) & (beta_new > 1e-14 * begin)
        v_old, v, beta = v, image / np.where(beta_new > 0, beta_new, 1), beta_new
    return apart(x)


def leading(product: Product, dim: int, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the `wanted` largest eigenvalues of a symmetric operator, falling.

    `product` multiplies a block of columns. Rayleigh-Ritz in a growing space gives pairs; the
    leading ones whose residuals reach double precision are locked, the others corrected.
    The space restarts from its best Ritz vectors when it is full; if it becomes the whole
    space the pairs are exact.
    """
    wanted = min(wanted, dim)
    most = min(dim, 4 * wanted + 8)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    space = _orthogonal(np.random.default_rng(seed).normal(size=(dim, min(wanted + 4, dim))))
    images = product(space)
    largest = 0.0
    for _ in range(MOST_ROUNDS):
        inner = space.T @ images
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        largest = max(largest, abs(theta[0]) if theta.size else 0.0, values.max(initial=0.0))
        left = wanted - values.size
        residual = images[:, :left] - space[:, :left] * theta[:left]
        whole = values.size + space.shape[1] >= dim
        done = np.linalg.norm(residual, axis=0) <= ROUNDINGS * np.finfo(float).eps * largest
        # in order: a pair is locked only after all larger ones
        good = left if whole else int(np.argmin(done)) if not done.all() else done.size
        locked = np.column_stack([locked, space[:, :good]])
        values = np.concatenate([values, theta[:good]])
        space, images, residual, theta = space[:, good:], images[:, good:], residual[:, good:], theta[good:]
        left -= good
        if left == 0:
            break
        if space.shape[1] + left > most - values.size:
            keep = min(space.shape[1], left + max(left // 2, 4))
            space, images = space[:, :keep], images[:, :keep]
        poor = ~done[good:]
        near = np.column_stack([locked, space[:, :left]])
        new = _corrections(product, near, theta[:left][poor], residual[:, poor])
        new = _orthogonal(new, locked, space)
        if not new.shape[1]:  # no correction left the space: look elsewhere
            new = _orthogonal(np.random.default_rng(seed + values.size + 1).normal(size=(dim, left)), locked, space)
        new = new[:, : dim - values.size - space.shape[1]]
        space, images = np.column_stack([space, new]), np.column_stack([images, product(new)])
        # locked directions stay out of the space
        space = space - locked @ (locked.T @ space)
    else:
        raise RuntimeError("eigenvectors did not reach double precision")
    order = np.argsort(-values, kind="stable")
    vectors = locked[:, order]
    # either sign is right; the largest entry decides, so that reruns agree
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1, 1)
    return values[order], vectors


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S without rounding; whole numbers of any size where 64 bits may not do."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _summed(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows of what a batch of numbers gives: within tasks, within groups of tasks, then GROUPS rows here."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = of_batch(_numbers(batch.column(0)))
                total = more if total is None else total + more
        if total is not None:
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([total.tobytes()], pa.binary())], ["g", "sum"])

    def together(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py()) for p in parts.column("sum"))
        return pa.table({"sum": pa.array([total.tobytes()], pa.binary())})

    summed = rows.mapInArrow(part, "g long, sum binary").groupBy("g").applyInArrow(together, "sum binary").collect()
    return sum(np.frombuffer(bytes(r["sum"])) for r in summed) if summed else None


def _sums(rows: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums per dimension, as Python numbers: the JVM adds decimals."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = _numbers(batch.column(0)).astype(object).sum(axis=0)
                columns = [pa.array(range(dim)), pa.array([str(t) for t in total]), pa.array([batch.num_rows] * dim)]
                yield pa.RecordBatch.from_arrays(columns, ["i", "s", "n"])

    parts = rows.mapInArrow(part, "i long, s string, n long").groupBy("i")
    found = parts.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return found[0]["n"], np.array([int(r["s"]) for r in found], object)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector of
    (vec_id, embedding) and each of the `components` leading eigenvectors of the covariance.

    Every product of the covariance is a pass over the centred numbers; no matrix of all
    dimensions is formed and only blocks of `components` columns reach the driver.

    Left out: vectors that are null, empty or hold null, non-finite or too large (LARGEST) entries, and those
    of another length than most (ties: the longer). Directions without variance are no components, so
    equal vectors, one vector or none give no rows. Repeated rows count each; a null vec_id stays. A
    deviation beyond 64 bits is null. Other columns are ignored.
    """
    vector = F.col("embedding")
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(LARGEST)))
    good = rows.where(vector.isNotNull() & (F.size(vector) > 0)).where(~odd)
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    table = settle(good.select("vec_id", whole.alias("x"), F.size(vector).alias("dim")))
    commonest = table.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if commonest is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim = commonest["dim"]
    table = table.where(F.col("dim") == dim)
    numbers = table.select("x")
    n, sums = _sums(numbers, dim)

    def centred(x: np.ndarray) -> np.ndarray:
        return _centred(x, n, sums).astype(np.float64) / n

    def product(block: np.ndarray) -> np.ndarray:
        if not block.shape[1]:
            return block

        def of_batch(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return (c.T @ (c @ block)).ravel()

        return _summed(numbers, of_batch).reshape(block.shape) / n

    trace = float(_summed(numbers, lambda x: np.array([(centred(x) ** 2).sum()]))[0]) / n
    values, vectors = leading(product, dim, components)
    real = values > ROUNDINGS * np.finfo(float).eps * max(values[0], 0)
    values, vectors = values[real], vectors[:, real]
    k = values.size
    if not k or trace <= 0:
        return rows.sparkSession.createDataFrame([], schema)

    def white(x: np.ndarray) -> np.ndarray:
        return centred(x) @ vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = white(x)
        return (w.T @ w).ravel()

    # centred numbers sum to zero, so the mean of what is whitened does too
    covariance = _summed(numbers, moments).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = values / trace

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _numbers(part.column(1))
                away = _centred(x, n, sums)
                # exact in 64 bits unless a rough value says otherwise
                wide = np.square(away.astype(np.float64)).sum(axis=1) >= 2.0**62
                exact = [None if w and s >= 1 << 63 else s for w, s in zip(wide, _squares(away, wide), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, n, np.int64)),
                        pa.array([e for e in exact for _ in range(k)], pa.int64()),
                        pa.array(white(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(x) * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return table.select("vec_id", "x").mapInArrow(out, schema)


def _squares(away: np.ndarray, wide: np.ndarray) -> list[int]:
    """Row sums of squares as whole numbers; rows that may pass 64 bits by Python's numbers."""
    if away.dtype == object or wide.any():
        return [sum(int(v) * int(v) for v in row) for row in away]
    return np.square(away).sum(axis=1).tolist()

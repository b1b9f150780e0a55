"""Near-duplicate embeddings by tiles of vectors in PCA order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalograft.llm.common import local_components, mix64
from catalograft.llm.components import components
from catalograft.llm.vectors import fit_sample, matrix, usable
from catalograft.session import settle

LEAST_COSINE = 0.95
#: Vectors the basis and the borders of the tiles are fitted on.
FIT_ROWS = 8_192
#: Vectors of a tile.
TILE_ROWS = 4_096
#: Leading dimensions of each step.
STEPS = (16, 32)
#: Rounding of single precision bounds; survivors are compared in double precision.
_SLACK = 1e-5


def _pca(sample: np.ndarray) -> np.ndarray:
    """An orthonormal basis, directions of most variance first. Any basis gives right results."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, basis = np.linalg.eigh(unit.T @ unit)
    return basis[:, ::-1].copy()


def links_of_tiles(x: np.ndarray, y: np.ndarray | None, basis: np.ndarray, least: float) -> Iterator[tuple]:
    """(i, j) index arrays of the pairs with cosine >= least; y None: pairs i < j within x.

    Leading dimensions are multiplied first; a pair goes on while its partial product plus the
    product of the suffix norms reaches the threshold. What is left is compared in double
    precision on the vectors as they are.
    """
    unit_x = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit_y = unit_x if y is None else y / np.linalg.norm(y, axis=1, keepdims=True)
    turned_x = (unit_x @ basis).astype(np.float32)
    turned_y = turned_x if y is None else (unit_y @ basis).astype(np.float32)
    steps = [s for s in STEPS if s < basis.shape[1]]
    first = steps[0] if steps else basis.shape[1]

    def suffix(v: np.ndarray, s: int) -> np.ndarray:
        return np.sqrt(np.maximum((v[:, s:].astype(np.float64) ** 2).sum(axis=1), 0)).astype(np.float32)

    # the bound as one product: leading dimensions and the suffix norm as one more
    lead_x = np.column_stack([turned_x[:, :first], suffix(turned_x, first)])
    lead_y = np.column_stack([turned_y[:, :first], suffix(turned_y, first)]).T.copy()
    suffixes = {s: (suffix(turned_x, s), suffix(turned_y, s)) for s in steps[1:]}
    floor = np.float32(least - _SLACK)
    for begin in range(0, len(x), 512):
        reach = lead_x[begin : begin + 512] @ lead_y >= floor
        if y is None:
            reach &= np.arange(len(x))[None, :] > np.arange(begin, begin + len(reach))[:, None]
        i, j = np.nonzero(reach)
        i += begin
        for at in range(0, i.size, 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            part = np.einsum("ij,ij->i", turned_x[a, :first], turned_y[b, :first])
            for low, high in zip(steps, steps[1:], strict=False):
                part += np.einsum("ij,ij->i", turned_x[a, low:high], turned_y[b, low:high])
                on = part + suffixes[high][0][a] * suffixes[high][1][b] >= floor
                a, b, part = a[on], b[on], part[on]
            good = np.einsum("ij,ij->i", unit_x[a], unit_y[b]) >= least
            if good.any():
                yield a[good], b[good]


def _tiles_of(turned_first: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.searchsorted(borders, turned_first, side="right")


def near_vectors(rows: DataFrame, least: float = LEAST_COSINE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of a table (vec_id, embedding).

    Equal vectors become one class with a count, so copies are never expanded. Classes are
    cut into tiles along the first principal direction; two tiles are compared unless their
    intervals lie further apart than vectors of that cosine can. Of each comparison come
    counts of links and a spanning forest.

    Null, zero or non-finite vectors: no link, a component of their own. Vectors of other
    lengths: compared among themselves only. Repeated vec_id: rows count as vectors of their
    own but share the id. Null vec_id: n_links as usual, never the smallest of a component.
    """
    rows = rows.select("vec_id", "embedding")
    good = usable(F.col("embedding"))
    classes = (
        rows.where(good)
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
        .select("embedding", "least_id", "n", F.size("embedding").alias("dim"))
    )
    classes = settle(classes.withColumn("class", F.monotonically_increasing_id()))
    found = None
    for dim, _ in sorted(tuple(r) for r in classes.groupBy("dim").count().collect()):
        part = _compare(classes.where(F.col("dim") == dim), least, tile_rows)
        found = part if found is None else found.union(part)
    if found is None:
        linked = classes.select("class", F.lit(0).cast("long").alias("other"), F.lit(None).cast("long").alias("component"))
    else:
        found = settle(found)
        others = found.where("kind = 0").groupBy(F.col("a").alias("k")).agg(F.sum("b").alias("other"))
        reached = components(found.where("kind = 1").select("a", "b"))
        linked = (
            classes.join(others, F.col("class") == F.col("k"), "left")
            .join(reached, F.col("class") == F.col("id"), "left")
            .select("class", "least_id", F.coalesce("other", F.lit(0)).alias("other"), F.coalesce("component", "class").alias("component"))
        )
        smallest = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
        linked = linked.join(smallest, "component").select("class", "other", "component_id")
    if found is None:
        linked = linked.withColumnRenamed("component", "component_id")
    known = classes.join(linked.withColumnRenamed("class", "l"), F.col("class") == F.col("l"))
    known = known.select(F.col("embedding").alias("e"), (F.col("n") - 1 + F.col("other")).alias("links"), "component_id")
    named = rows.join(known, good & (F.col("embedding") == F.col("e")), "left")
    component = F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return named.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _compare(classes: DataFrame, least: float, tile_rows: int) -> DataFrame:
    """Rows (kind, a, b): kind 0, class a has b more links; kind 1, a link of the forest."""
    sample = fit_sample(classes, "embedding", FIT_ROWS)
    basis = _pca(sample)
    n = classes.count()
    first = np.sort((sample / np.linalg.norm(sample, axis=1, keepdims=True)) @ basis[:, 0])
    wanted = max(-(-n // tile_rows), 1)
    borders = np.unique(np.quantile(first, np.arange(1, wanted) / wanted))
    width = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-9

    def place(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(batch.column(0))
        return x, _tiles_of((x / np.linalg.norm(x, axis=1, keepdims=True)) @ basis[:, 0], borders)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(borders.size + 1, np.int64)
        for batch in batches:
            total += np.bincount(place(batch)[1], minlength=total.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], ["interval", "n"])

    sizes = np.zeros(borders.size + 1, np.int64)
    counted = classes.select("embedding").mapInArrow(count, "interval long, n long")
    for r in counted.groupBy("interval").agg(F.sum("n").alias("n")).collect():  # one row per interval
        sizes[r["interval"]] = r["n"]
    # an interval with many vectors is several tiles
    parts = np.maximum(-(-sizes // tile_rows), 1)
    start = np.cumsum(parts) - parts
    interval = np.repeat(np.arange(parts.size), parts)
    low = np.concatenate([[-np.inf], borders])[interval]
    high = np.concatenate([borders, [np.inf]])[interval]
    # tiles lie in order: each meets itself and those up to the last that starts within reach
    last = np.searchsorted(low, high + width, side="right") - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = place(batch)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            tile = start[at] + (mix64(ids.astype(np.uint64)) % parts[at].astype(np.uint64)).astype(np.int64)
            left, right, side, blocks = [], [], [], []
            for t in np.unique(tile):
                mine = tile == t
                block = tuple(v[mine].tobytes() for v in (ids.astype("<i8"), n.astype("<i8"), x))
                for other in range(t, last[t] + 1):
                    left.append(t), right.append(other), side.append(0), blocks.append(block)
                for other in np.flatnonzero((last[:t] >= t)):
                    left.append(other), right.append(t), side.append(1), blocks.append(block)
            for s in range(0, len(left), 64):
                columns = zip(*blocks[s : s + 64], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[s : s + 64], pa.int64()) for v in (left, right, side)] + [pa.array(c, pa.binary()) for c in columns],
                    ["i", "j", "side", "ids", "n", "x"],
                )

    dim = basis.shape[0]

    def compare(tiles: pa.Table) -> pa.Table:
        sides = []
        for s in (0, 1):
            rows = [r for r in tiles.to_pylist() if r["side"] == s]
            ids, n = (np.frombuffer(b"".join(r[c] for r in rows), "<i8") for c in ("ids", "n"))
            sides.append((ids, n, np.frombuffer(b"".join(r["x"] for r in rows)).reshape(-1, dim)))
        (ids, n, x), (ids_y, n_y, y) = sides
        same = tiles.column("i")[0].as_py() == tiles.column("j")[0].as_py()
        if same:
            ids_y, n_y = ids, n
        more_x, more_y = np.zeros(ids.size, np.int64), np.zeros(ids_y.size, np.int64)
        if same:
            more_y = more_x
        forest = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pairs = links_of_tiles(x, None if same else y, basis, least) if len(x) and len(ids_y) else ()
        for i, j in pairs:
            np.add.at(more_x, i, n_y[j])
            np.add.at(more_y, j, n[i])
            nodes, root = local_components(np.concatenate([forest[0], ids[i]]), np.concatenate([forest[1], ids_y[j]]))
            forest = nodes[nodes != root], root[nodes != root]
        out_a, out_b, kind = [forest[0]], [forest[1]], [np.ones(forest[0].size, np.int32)]
        for who, more in [(ids, more_x)] if same else [(ids, more_x), (ids_y, more_y)]:
            on = more > 0
            out_a.append(who[on]), out_b.append(more[on]), kind.append(np.zeros(int(on.sum()), np.int32))
        return pa.table({"kind": np.concatenate(kind), "a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    dealt = classes.select("embedding", "class", "n").mapInArrow(
        deal, "i long, j long, side long, ids binary, n binary, x binary"
    )
    return dealt.groupBy("i", "j").applyInArrow(compare, "kind int, a long, b long")

"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalograft.llm.common import mix64
from catalograft.llm.vectors import fit_sample, matrix, usable
from catalograft.session import settle

#: Vectors a tree is fitted on: of the table for the first level, of a cell for the next ones.
FIT_ROWS = 16_384
BRANCHES = 8
#: Rows a leaf should hold.
LEAF_ROWS = 256
#: Leaves wanted of one tree at most; its leaves are cells with trees of their own while they are large.
TREE_LEAVES = FIT_ROWS // 16
#: A cell of more than so many leaves' rows gets a tree.
SPLIT = 16
#: Levels of trees at most; cells are numbered in _BITS bits a level.
LEVELS = 4
_BITS = 15
#: Queries whose true neighbours are found among all rows to calibrate the leaf visits.
CALIBRATION = 64
#: Recall wanted on those; above the 0.9 promised, for queries differ.
RECALL = 0.96
#: Rows of a block of one leaf.
BLOCK_ROWS = 2_048
#: Rows of one cell that a task gathers.
PART_ROWS = 65_536
#: Queries whose visits are found together, and that are compared with rows of a leaf together.
CHUNK = 1_024
COMPARED = 256
#: Bytes of the queries, and of the neighbours kept of each, that a task holds.
SHARE_BYTES = 1 << 27
#: Rows that pass one task of the search, where that is more than two tasks a core.
PASS_ROWS = 1 << 20
#: Kinds of rows that meet in a task, in the order they come.
_VECTORS, _VISITS, _THINGS = range(3)


@dataclass
class Tree:
    """Inner nodes hold the centres of their children; a child is a node or a leaf (-1 - leaf)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_rows: int, seed: int = 5) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)
        tree._split(sample, max(leaf_rows, 1), rng)
        return tree

    def _split(self, x: np.ndarray, leaf_rows: int, rng) -> int:
        if len(x) <= leaf_rows or (x == x[0]).all():
            self.leaves += 1
            return -self.leaves
        k = int(min(BRANCHES, max(2, -(-len(x) // leaf_rows))))
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            nearest = _nearest(x, centres)
            used = np.unique(nearest)
            centres = np.stack([x[nearest == c].mean(axis=0) for c in used])
        nearest = _nearest(x, centres)
        used = np.unique(nearest)
        if used.size == 1:
            self.leaves += 1
            return -self.leaves
        number = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[number] = [self._split(x[nearest == c], leaf_rows, rng) for c in used]
        return number

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row belongs to: down the nearest centres."""
        out = np.zeros(len(x), np.int64)
        if self.centres:
            self._down(0, x, np.arange(len(x)), out)
        return out

    def _down(self, node: int, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        nearest = _nearest(x[rows], self.centres[node])
        for c, child in enumerate(self.children[node]):
            mine = rows[nearest == c]
            if mine.size and child < 0:
                out[mine] = -1 - child
            elif mine.size:
                self._down(child, x, mine, out)

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: the queue holds every branch not taken by its distance."""
        if not self.centres:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            apart = ((self.centres[node] - query) ** 2).sum(axis=1)
            for d, child in zip(apart.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def _rough(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances less the queries' own squares, a line a query; for choosing only."""
    return (x**2).sum(axis=1)[None, :] - 2 * queries @ x.T


def _best(ids: np.ndarray, x: np.ndarray, query: np.ndarray, own: int | None, k: int, rough: np.ndarray):
    """(ids, distances) of the k nearest rows, ties to the smaller id; exact distances."""
    if own is not None:
        rough = np.where(ids == own, np.inf, rough)
    if rough.size > k:
        bound = np.partition(rough, k - 1)[k - 1]
        near = np.flatnonzero(rough <= bound + 1e-9 * (1 + abs(bound)))
    else:
        near = np.arange(rough.size)
    near = near[np.isfinite(rough[near])]
    exact = np.sqrt(((x[near] - query) ** 2).sum(axis=1))
    order = np.lexsort((ids[near], exact))[:k]
    return ids[near][order], exact[order]


class _Kept:
    """The k nearest of each query seen by one task."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.found:
            ids, scores = (np.concatenate(p) for p in zip(self.found[query], (ids, scores), strict=True))
            order = np.lexsort((ids, scores))[: self.k]
            ids, scores = ids[order], scores[order]
        self.found[query] = ids, scores

    def add_block(self, ids: np.ndarray, x: np.ndarray, queries: list[int], q: np.ndarray) -> None:
        """Rows of a block for each query; none where all lie beyond the k kept already."""
        rough, squares = _rough(x, q), (q**2).sum(axis=1)
        worst = np.array([self._worst(own) for own in queries]) ** 2
        slack = 1e-9 * (1 + squares + np.where(np.isfinite(worst), worst, 0))
        for at in np.flatnonzero(rough.min(axis=1) + squares <= worst + slack).tolist():
            self.add(queries[at], *_best(ids, x, q[at], queries[at], self.k, rough[at]))

    def _worst(self, query: int) -> float:
        scores = self.found[query][1] if query in self.found else ()
        return scores[-1] if len(scores) >= self.k else np.inf

    def taken(self) -> pa.RecordBatch:
        found, self.found = self.found, {}
        query = [np.full(len(i), q, np.int64) for q, (i, _) in found.items()]
        ids, scores = ([p[n] for p in found.values()] for n in (0, 1))
        empty = np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(c) if c else empty, t)
                for c, t in ((query, pa.int64()), (ids, pa.int64()), (scores, pa.float64()))
            ],
            ["query_id", "vec_id", "score"],
        )


def _width(vectors: DataFrame) -> str:
    """The numbers vectors are kept in: as narrow as those of their column."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"


def _doubles(x: bytes, width: str, dim: int) -> np.ndarray:
    return np.frombuffer(x, width).reshape(-1, dim).astype(np.float64, copy=False)


def _cut(cell: np.ndarray, ids: np.ndarray, x: np.ndarray, width: str) -> list[tuple[int, bytes, bytes]]:
    """Rows as blocks of one cell each."""
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    blocks = []
    for begin, end in zip(starts, [*starts[1:], len(order)], strict=True):
        for s in range(begin, end, BLOCK_ROWS):
            part = order[s : min(s + BLOCK_ROWS, end)]
            blocks.append((int(cell[part[0]]), ids[part].astype("<i8").tobytes(), x[part].astype(width).tobytes()))
    return blocks


def _visits_of(tree: Tree, visits: int, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(leaf, ids) of the queries that visit a leaf."""
    to: dict[int, list[int]] = {}
    for i in range(len(ids)):
        for _, leaf in zip(range(visits), tree.visit(x[i]), strict=False):
            to.setdefault(leaf, []).append(i)
    for leaf, i in to.items():
        yield leaf, ids[i].astype("<i8").tobytes()


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (share, cell, queries, q): the vectors of some queries, without a cell, or who visits a cell, without vectors."""
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["share", "cell", "queries", "q"])


def _packed(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    """Rows (long, binary, binary)."""
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    types = (pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def _gathered(table: pa.Table, dim: int, width: str) -> tuple[np.ndarray, np.ndarray]:
    ids, x = (b"".join(table.column(c).to_pylist()) for c in ("ids", "x"))
    return np.frombuffer(ids, "<i8"), _doubles(x, width, dim)


def _tree(row: pa.Table) -> tuple[int, Tree]:
    """The number before a cell's children, and its tree."""
    return _first(row.column("of")[0].as_py()), pickle.loads(row.column("tree")[0].as_py())


def _first(cell: int) -> int:
    return (cell + 1) << _BITS


def _trees_of(blocks: DataFrame, level: int, leaf_rows: int, tree_leaves: int, dim: int, width: str) -> DataFrame | None:
    """(cell, n, tree) of the large cells made at a level; None where there are none.

    A tree is fitted in one task on about FIT_ROWS rows of its cell, drawn by block and place.
    Cells whose rows are all alike get none.
    """
    mine = blocks.where(F.col("level") == level)
    sizes = mine.groupBy("cell").agg(F.sum(F.length("ids") / 8).cast("long").alias("n"))
    sizes = settle(sizes.where(F.col("n") > SPLIT * leaf_rows))
    if sizes.isEmpty():
        return None

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n, block = (batch.column(c).to_pylist() for c in range(3))
            picked = []
            for c, m, number, x in zip(cell, n, block, batch.column(3), strict=True):
                x = np.frombuffer(x.as_py(), width).reshape(-1, dim)
                place = np.uint64(number * BLOCK_ROWS % 2**64) + np.arange(len(x), dtype=np.uint64)
                picked.append((c, m, x[mix64(place) < np.uint64(min(FIT_ROWS / m, 1) * (2**64 - 2**12))].tobytes()))
            columns = zip(*picked, strict=True) if picked else ([], [], [])
            types = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["cell", "n", "x"])

    def fit(drawn: pa.Table) -> pa.Table:
        x = _doubles(b"".join(drawn.column("x").to_pylist()), width, dim)
        cell, n = (drawn.column(c)[0].as_py() for c in ("cell", "n"))
        leaves = max(2, min(n // leaf_rows, tree_leaves))
        tree = Tree.fit(x, -(-len(x) // leaves)) if len(x) else Tree(leaves=1)
        rows = [(cell, n, pickle.dumps(tree))] if tree.leaves > 1 else []
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        types = (pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["cell", "n", "tree"])

    drawn = mine.join(sizes, "cell").select("cell", "n", "block", "x").mapInArrow(draw, "cell long, n long, x binary")
    trees = settle(drawn.groupBy("cell").applyInArrow(fit, "cell long, n long, tree binary"))
    return None if trees.isEmpty() else trees


def _deeper(blocks: DataFrame, trees: DataFrame, level: int, dim: int, width: str) -> DataFrame:
    """Blocks with the rows of cells that have a tree in its leaves; a large cell is many tasks."""

    def down(rows: pa.Table, tree: pa.Table) -> pa.Table:
        cut = []
        if rows.num_rows and tree.num_rows:
            first, mine = _tree(tree)
            ids, x = _gathered(rows, dim, width)
            cut = _cut(first + mine.leaf_of(x), ids, x, width)
        return pa.Table.from_batches([_packed(cut, ("cell", "ids", "x"))])

    parts = F.ceil(F.col("n") / PART_ROWS)
    known = blocks.join(trees.select("cell", "n"), "cell", "left")
    moved = known.where("n is not null").withColumn("part", F.pmod(F.xxhash64("block"), parts))
    dealt = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("of_part")
    copies = trees.select(F.col("cell").alias("of"), dealt, "tree")
    moved = (
        moved.select("cell", "part", "ids", "x")
        .groupBy("cell", "part")
        .cogroup(copies.groupBy("of", "of_part"))
        .applyInArrow(down, "cell long, ids binary, x binary")
    )
    stay = known.where("n is null").select("cell", "ids", "x", "level")
    return _numbered(stay.union(moved.withColumn("level", F.lit(level + 1))))


def _numbered(blocks: DataFrame) -> DataFrame:
    return settle(blocks.withColumn("block", F.monotonically_increasing_id()))


def _met(asked: DataFrame, things: DataFrame, parts: int, shares: int, wide: DataFrame | None = None) -> DataFrame:
    """(task, kind, cell, ids, x): what a task needs to pass the things of its part by the queries of its share.

    In: what `_asked` makes, and things (cell, spread, ids, x); the things of a cell lie in `spread`
    parts, in more than one if the cell is among `wide` (cell, spread). A task gets the vectors of its queries, then who visits which cell, then the things by cell: it
    holds the queries, and the things stream by. A query's vector is sent once to each part, whatever it visits.
    """

    def each(n) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    def of(kind: int, *columns: str) -> list[Column]:
        task = (F.pmod(F.col("part"), F.lit(parts)) * shares + F.col("share")).cast("int")
        return [task.alias("task"), F.lit(kind).alias("kind"), "cell", *(F.col(c).alias(n) for c, n in zip(columns, ("ids", "x"), strict=True))]

    home = F.pmod(F.xxhash64("cell"), F.lit(parts))
    vectors = asked.where("cell is null").withColumn("part", each(F.lit(parts).cast("long"))).select(*of(_VECTORS, "queries", "q"))
    one = F.lit(1).cast("long")
    visits = asked.where("cell is not null")
    visits = visits.withColumn("spread", one) if wide is None else visits.join(wide, "cell", "left")
    visits = visits.withColumn("nth", each(F.coalesce("spread", one))).withColumn("part", home + F.col("nth")).select(*of(_VISITS, "queries", "q"))
    passing = things.withColumn("part", home + F.pmod(F.xxhash64("ids"), F.col("spread"))).withColumn("share", each(F.lit(shares).cast("long")))
    dealt = vectors.unionByName(visits).unionByName(passing.select(*of(_THINGS, "ids", "x")))
    return dealt.repartitionById(parts * shares, "task").sortWithinPartitions("task", "kind", "cell")


def _meetings(batches: Iterator[pa.RecordBatch], dim: int, width: str) -> Iterator[tuple]:
    """(task, cell, ids, x, queries, q) of what `_met` dealt: each thing of a cell, and the queries that visit the cell.

    The queries of a cell are the same objects for all its things.
    """
    task = at = None
    for batch in batches:
        for t, kind, cell, ids, x in zip(*(batch.column(c) for c in range(5)), strict=True):
            t, kind, cell = t.as_py(), kind.as_py(), cell.as_py()
            if t != task:
                task, at, asking, held, visits = t, None, None, [], {}
            if kind == _VECTORS:
                held.append((np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(x.as_py(), width).reshape(-1, dim)))
            elif kind == _VISITS:
                visits.setdefault(cell, []).append(np.frombuffer(ids.as_py(), "<i8"))
            else:
                if held:
                    known, vectors = (np.concatenate(v) for v in zip(*held, strict=True))
                    order = np.argsort(known)
                    known, vectors, held = known[order], vectors[order], []
                if cell != at:
                    at, asking = cell, visits.pop(cell, None)
                    if asking is not None:
                        asking = np.concatenate(asking)
                        q = vectors[np.searchsorted(known, asking)].astype(np.float64, copy=False)
                if asking is not None:
                    yield task, cell, ids.as_py(), x.as_py(), asking, q


def _route_deeper(asked: DataFrame, trees: DataFrame, visits: int, parts: int, shares: int, dim: int, width: str) -> DataFrame:
    """Queries at cells that have a tree go on to the leaves they visit there."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, cell, _, tree, queries, q in _meetings(batches, dim, width):
            first, mine = _first(cell), pickle.loads(tree)
            for s in range(0, len(queries), CHUNK):
                some = slice(s, s + CHUNK)
                yield _asked([(task % shares, first + leaf, i, None) for leaf, i in _visits_of(mine, visits, queries[some], q[some])])

    split = trees.select("cell", F.lit(True).alias("split"))
    known = asked.join(split, "cell", "left").select(*asked.columns, "split")
    things = trees.select("cell", F.lit(1).cast("long").alias("spread"), F.lit(b"").alias("ids"), F.col("tree").alias("x"))
    going = known.where("split or cell is null").drop("split")
    gone = _met(going, things, parts, shares).mapInArrow(visit, asked.schema)
    return known.where("split is null").drop("split").unionByName(gone)


def _place_deeper(truth: DataFrame, trees: DataFrame) -> DataFrame:
    """True neighbours with the leaf they lie in and its place in their query's order of visits."""

    def place(rows: pa.Table, tree: pa.Table) -> pa.Table:
        out = rows.to_pylist()
        if tree.num_rows:
            first, mine = _tree(tree)
            for r in out:
                leaf = int(mine.leaf_of(np.array([r["v"]], np.float64))[0])
                r["place"] = 1 + next(p for p, at in enumerate(mine.visit(np.array(r["q"], np.float64))) if at == leaf)
                r["cell"] = first + leaf
        else:
            for r in out:
                r["place"] = 1
        return pa.Table.from_pylist(out, rows.schema)

    keep = trees.join(truth.select("cell").distinct(), "cell", "left_semi").select(F.col("cell").alias("of"), "tree")
    return truth.groupBy("cell").cogroup(keep.groupBy("of")).applyInArrow(place, truth.schema)


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    recall: float = RECALL,
    leaf_rows: int = LEAF_ROWS,
    tree_leaves: int = TREE_LEAVES,
    report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest rows of each query by distance.

    In: two tables (vec_id, embedding). The first tree is fitted on FIT_ROWS vectors and has
    about `tree_leaves` leaves at most; every row is put in its leaf. Leaves that are still
    large become cells with a tree of their own, fitted in a task and kept in a table, so
    leaves grow with the rows while the driver holds the first tree alone. CALIBRATION queries
    are compared with all rows, and leaf visits are widened, level by level, until the leaves
    visited hold the share `recall` of their true neighbours; so many leaves are visited for
    each query. A task of the search holds the queries of a share, at most SHARE_BYTES, and
    rows of its part of the leaves stream by; leaves of over PART_ROWS lie in several parts. `report`, if given, gets leaves (of the first tree), visits (of each level),
    levels and that recall.

    Rows and queries that are null, zero or hold null or non-finite components take no part,
    nor do null ids and vectors of another length than most of the sample. A row with the
    query's vec_id is the query's own. Ties: smaller vec_id first. Repeated rows are found as
    often as they occur; of a repeated query id the smallest vector counts. Fewer than k
    candidates: all of them. Empty tables: no rows.
    """
    schema = "query_id long, vec_id long, score double"
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows, queries = (t.where(good).select("vec_id", "embedding") for t in (rows, queries))
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]
    rows, queries = (t.where(F.size("embedding") == dim) for t in (rows, queries))
    width, query_width = _width(rows), _width(queries)
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = fit_sample(rows, "embedding", FIT_ROWS)
    leaves = max(1, min(n // leaf_rows, tree_leaves))
    tree = Tree.fit(sample, -(-len(sample) // leaves))

    probes = [
        (q, np.array(v, np.float64))
        for q, v in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()
    ]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by leaf in blocks, made of many batches."""
        held, many = [], 0

        def taken() -> pa.RecordBatch:
            ids, x = (np.concatenate(v) for v in zip(*held, strict=True))
            return _packed(_cut(tree.leaf_of(x), ids, x, width), ("cell", "ids", "x"))

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))))
                many += batch.num_rows
            if many >= PART_ROWS:
                yield taken()
                held, many = [], 0
        if held:
            yield taken()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(k)
        for batch in batches:
            for ids, x in zip(batch.column(0), batch.column(1), strict=True):
                if probes:
                    ids, x = np.frombuffer(ids.as_py(), "<i8"), _doubles(x.as_py(), width, dim)
                    kept.add_block(ids, x, [q for q, _ in probes], np.stack([v for _, v in probes]))
        yield kept.taken()

    blocks = _numbered(rows.mapInArrow(index, "cell long, ids binary, x binary").withColumn("level", F.lit(1)))
    deeper: list[DataFrame] = []
    while len(deeper) + 1 < LEVELS:
        trees = _trees_of(blocks, len(deeper) + 1, leaf_rows, tree_leaves, dim, width)
        if trees is None:
            break
        deeper.append(trees)
        blocks = _deeper(blocks, trees, len(deeper), dim, width)

    # true neighbours of the probes, k of each; where they lie tells how many leaves to visit
    truth = _top(blocks.select("ids", "x").mapInArrow(probe, schema), k)
    truth = F.broadcast(truth).join(rows.withColumnRenamed("vec_id", "v"), F.col("vec_id") == F.col("v"))
    # however often an id occurs, one vector of each true neighbour reaches the driver
    truth = truth.groupBy("query_id", "rank").agg(F.min("embedding").alias("embedding")).collect()
    order = {q: {leaf: p for p, leaf in enumerate(tree.visit(v))} for q, v in probes}
    leaf = tree.leaf_of(np.array([t["embedding"] for t in truth], np.float64)).tolist() if truth else []
    places = [[order[t["query_id"]][at] + 1 for t, at in zip(truth, leaf, strict=True)]]
    if deeper and truth:
        vector = dict(probes)
        at = [
            (number, vector[t["query_id"]].tolist(), [float(v) for v in t["embedding"]], cell, 1)
            for number, (t, cell) in enumerate(zip(truth, leaf, strict=True))
        ]
        at = spark.createDataFrame(at, "number long, q array<double>, v array<double>, cell long, place long")
        for trees in deeper:
            at = settle(_place_deeper(at, trees))
            places.append([r["place"] for r in at.orderBy("number").select("place").collect()])
    visits = _widened(places, recall, 1 + len(deeper))
    if report is not None:
        held = [all(p <= v for p, v in zip(way, visits, strict=False)) for way in zip(*places, strict=True)]
        got = sum(held) / len(held) if held else 1.0
        report.update(leaves=tree.leaves, visits=visits, levels=len(visits), recall=got)

    asking = queries.count()
    shares = max(1, -(-asking * (8 * dim + 16 * k + 512) // SHARE_BYTES))
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-n // PASS_ROWS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries by the leaves they visit; their vectors once, beside."""
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)) if batch.num_rows else None
            share = mix64(ids) % np.uint64(shares)
            for number in np.unique(share).tolist():
                mine = np.flatnonzero(share == number)
                for i in (mine[s : s + CHUNK] for s in range(0, len(mine), CHUNK)):
                    vectors = (number, None, ids[i].astype("<i8").tobytes(), x[i].astype(query_width).tobytes())
                    yield _asked([vectors, *((number, leaf, at, None) for leaf, at in _visits_of(tree, visits[0], ids[i], x[i]))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, last, held = _Kept(k), None, []

        def compare() -> None:
            ids, x = (b"".join(v) for v in zip(*held, strict=True))
            ids, x = np.frombuffer(ids, "<i8"), _doubles(x, width, dim)
            for s in range(0, len(last[2]), COMPARED):
                kept.add_block(ids, x, last[2][s : s + COMPARED].tolist(), last[3][s : s + COMPARED])
            held.clear()

        for task, cell, ids, x, asked, q in _meetings(batches, dim, query_width):
            # small blocks of a cell are compared together
            if held and (last[:2] != (task, cell) or sum(len(i) for i, _ in held) >= 8 * BLOCK_ROWS):
                compare()
            if last and last[0] != task:
                yield kept.taken()
            last = task, cell, asked, q
            held.append((ids, x))
        if held:
            compare()
        yield kept.taken()

    # the queries may lie in one file; routing them takes all cores
    routed = settle(queries.repartition(parts, "vec_id").mapInArrow(route, "share long, cell long, queries binary, q binary"))
    for trees, wide in zip(deeper, visits[1:], strict=True):
        routed = settle(_route_deeper(routed, trees, wide, parts, shares, dim, query_width))

    # leaves that stayed large, of vectors that are alike, lie in several parts
    hot = blocks.groupBy("cell").agg(F.least(F.ceil(F.sum(F.length("ids") / 8) / PART_ROWS), F.lit(parts).cast("long")).alias("spread"))
    hot = settle(hot.where("spread > 1"))
    things = blocks.join(hot, "cell", "left").withColumn("spread", F.coalesce("spread", F.lit(1).cast("long")))
    met = _met(routed, things.select("cell", "spread", "ids", "x"), parts, shares, hot)
    return _top(met.mapInArrow(search, schema), k).select("query_id", "rank", "vec_id", "score")


def _widened(places: list[list[int]], recall: float, levels: int) -> list[int]:
    """Leaves to visit at each level, so that after the last the share `recall` is still held."""
    left, visits = list(range(len(places[0]))), []
    for level in range(levels):
        at = places[level] if level < len(places) else []
        wanted = recall ** ((level + 1) / levels) * len(places[0])
        wide = 1
        while at and sum(at[i] <= wide for i in left) < min(wanted, len(left)):
            wide += 1
        left = [i for i in left if at[i] <= wide] if at else left
        visits.append(wide)
    return visits


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

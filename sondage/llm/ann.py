"""Approximate nearest neighbours by inner product through stable projections.

Inner products become distances: with M the greatest norm of all, x gets one more
coordinate sqrt(M^2 - |x|^2) and a query a zero, so the nearest by distance is the greatest
inner product. Vectors are projected to `m` dimensions by fixed Gaussian (2-stable)
directions. For a vector at distance d, the squared projected distance over d^2 has a
chi-square distribution with m degrees of freedom; so once all that is left is at a projected
distance r or more, and the chi-square distribution at r^2 / d_k^2 reaches `sure` for the
k-th best distance d_k so far, anything closer has been seen with that probability.

One kd-tree over all projections, split by a bounded sample, deals all vectors to cells, of which
exact bounding boxes are kept. A query first goes to its nearest cell, which gives a bound for
d_k, and then to every cell that the chi-square test at this bound still demands. In a cell a
kd-tree goes on to small leaves: a query takes leaves in the order of their projected
distance, projected neighbours in them are verified by the original vectors until the test
holds, and d_k falls on the way. Data are never copied for queries, except for cells that very
many queries want; only queries travel, to the cells that they demand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import checkpoint

_RESULT = "query_id long, block long, verified long, vec_id long, score double"


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """Distribution function for an even number m of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(sure: float, m: int) -> float:
    """Where the chi-square distribution reaches `sure`."""
    low, high = 0.0, 1400.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array([middle]), m)[0] < sure else (low, middle)
    return high


def directions(dims: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, m))


def _box_distances(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for a in range(q.shape[1]):
        x = q[:, a : a + 1]
        gap = np.maximum(np.maximum(low[:, a] - x, x - high[:, a]), 0)
        out += gap * gap
    return out


class KdTree:
    """Leaves of at most `leaf` points, split at the median of the widest coordinate."""

    def __init__(self, points: np.ndarray, leaf: int):
        todo, self.leaves = [np.arange(len(points))], []
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            p = points[own]
            axis, half = int(np.argmax(p.max(axis=0) - p.min(axis=0))), len(own) // 2
            order = np.argpartition(p[:, axis], half)
            todo += [own[order[half:]], own[order[:half]]]
        self.low = np.stack([points[o].min(axis=0) for o in self.leaves])
        self.high = np.stack([points[o].max(axis=0) for o in self.leaves])


class Cells:
    """The upper levels of the tree: at most `count` cells, split by a sample of the points."""

    def __init__(self, sample: np.ndarray, count: int):
        self.axis, self.cut, self.child = [-1], [0.0], [(0, 0)]  # a node with axis -1 is a cell
        sizes = [(0, np.arange(len(sample)), count)]
        while sizes:
            node, own, want = sizes.pop()
            if want < 2 or len(own) < 2:
                continue
            p = sample[own]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            cut = float(np.quantile(p[:, axis], (want // 2) / want))
            left = p[:, axis] < cut
            if not left.any():
                continue
            self.axis[node], self.cut[node], self.child[node] = axis, cut, (len(self.axis), len(self.axis) + 1)
            for side, part in ((left, want // 2), (~left, want - want // 2)):
                sizes.append((len(self.axis), own[side], part))
                self.axis.append(-1)
                self.cut.append(0.0)
                self.child.append((0, 0))
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell (its node) of each point."""
        node = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = self.child[at, (points[inner, self.axis[at]] >= self.cut[at]).astype(int)]


class Block:
    """One cell's vectors, or a part of them, ready for searches."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, greatest: float, to: np.ndarray, leaf: int):
        # equal vectors are one point of the tree, in the order of their smallest id
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        _, first, of = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        place = np.empty(len(first), dtype=np.int64)
        place[np.argsort(first)] = np.arange(len(first))
        of = place[of.ravel()]
        self.points, self.greatest, self.to = vectors[np.sort(first)], greatest, to
        self.members = ids[np.argsort(of, kind="stable")]
        self.begin = np.searchsorted(np.sort(of), np.arange(len(first) + 1))
        wide = np.sqrt(np.maximum(greatest - (self.points * self.points).sum(axis=1), 0))
        self.at = np.column_stack((self.points, wide)) @ to
        self.square = (self.at * self.at).sum(axis=1)
        self.tree = KdTree(self.at, leaf)

    def search(self, queries: np.ndarray, bound: np.ndarray, keep: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, score) of the `keep` best points of each query with a score of `bound` or
        more, and how many points were verified for each query. `limit` is the quantile of the test."""
        n, at = len(queries), queries @ self.to[:-1]
        away = _box_distances(self.tree.low, self.tree.high, at)
        order = np.argsort(away, axis=1, kind="stable")
        away = np.take_along_axis(away, order, axis=1)
        total, square = (queries * queries).sum(axis=1) + self.greatest, (at * at).sum(axis=1)
        worst, verified = bound.astype(float), np.zeros(n, dtype=np.int64)
        who, what, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        active, low, step, count = np.arange(n), 0, 1, len(self.tree.leaves)
        reach = lambda q: limit * np.maximum(total[q] - 2 * worst[q], 1e-9)
        while low < count:
            active = active[away[active, low] < reach(active)]
            if not len(active):
                break
            picked, near = order[active, low : low + step], away[active, low : low + step] < reach(active)[:, None]
            found = [(who, what, score)]
            for leaf in np.unique(picked[near]).tolist():
                own, rows = self.tree.leaves[leaf], active[((picked == leaf) & near).any(axis=1)]
                apart = square[rows, None] + self.square[own] - 2 * at[rows] @ self.at[own].T
                i, j = np.nonzero(apart < reach(rows)[:, None])
                i, j = rows[i], own[j]
                verified += np.bincount(i, minlength=n)
                s = np.einsum("ij,ij->i", queries[i], self.points[j])
                good = s >= worst[i]
                found.append((i[good], j[good], s[good]))
            who, what, score = (np.concatenate(x) for x in zip(*found, strict=True))
            best = np.lexsort((what, -score, who))
            who, what, score = who[best], what[best], score[best]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            full = place == keep - 1
            worst[who[full]] = np.maximum(worst[who[full]], score[full])
            who, what, score = who[place < keep], what[place < keep], score[place < keep]
            low, step = low + step, min(2 * step, max(1, count // 8))
        return who, what, score, verified


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _answers(block: Block, number: int, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int, limit: float) -> pa.RecordBatch:
    """The k best of each query, its own id left out, ties to the smaller id; a row without
    vec_id for a query with none."""
    who, point, score, verified = block.search(queries, bound, k + 1, limit)
    sizes = np.minimum(block.begin[point + 1] - block.begin[point], k + 1)
    at = np.repeat(block.begin[point] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    who, score, vec = np.repeat(who, sizes), np.repeat(score, sizes), block.members[at]
    other = vec != ids[who]
    who, score, vec = who[other], score[other], vec[other]
    best = np.lexsort((vec, -score, who))
    who, score, vec = who[best], score[best], vec[best]
    first = np.arange(len(who)) - np.searchsorted(who, who) < k
    who, score, vec = who[first], score[first], vec[first]
    none = np.setdiff1d(np.arange(len(ids)), who)
    who = np.concatenate((who, none))
    vec, score = (pa.array(np.concatenate((x, np.zeros(len(none), x.dtype))), mask=np.arange(len(who)) >= len(x)) for x in (vec, score))
    return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(np.full(len(who), number)), pa.array(verified[who]), vec, score], names=["query_id", "block", "verified", "vec_id", "score"])


class _Search:
    """A search of `data` (vec_id, embedding, cell) by queries; see nearest()."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int, m: int, sure: float, leaf: int, data_rows: int, query_rows: int, sample_rows: int, most_cells: int):
        if m < 2 or m % 2:
            raise ValueError("m must be even")
        self.spark, self.k, self.leaf, self.query_rows, self.limit = vectors.sparkSession, k, leaf, query_rows, quantile(sure, m)
        data, asked = _clean(vectors), _clean(queries)
        norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
        kinds = data.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("greatest")).orderBy(F.desc("n"), "dims").limit(1).collect()
        self.rows = kinds[0]["n"] if kinds else 0
        if not kinds:
            return
        self.dims, self.greatest = kinds[0]["dims"], kinds[0]["greatest"]
        data, self.asked = (x.where(F.size("embedding") == self.dims) for x in (data, asked))
        self.to = directions(self.dims + 1, m)
        share = min(1.0, sample_rows / self.rows)
        sample = data.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)).select("embedding").toArrow()["embedding"].combine_chunks()
        tasks = 2 * self.spark.sparkContext.defaultParallelism
        count = max(math.ceil(self.rows / data_rows), min(tasks, math.ceil(self.rows / 2048)))
        self.cells = Cells(self._project(_matrix(sample, self.dims)) if len(sample) else np.zeros((1, m)), min(count, most_cells))
        self.data = self._with_cells(data)
        self._boxes(data_rows)

    def _project(self, x: np.ndarray) -> np.ndarray:
        wide = np.sqrt(np.maximum(self.greatest - (x * x).sum(axis=1), 0))
        return np.column_stack((x, wide)) @ self.to

    def _parts(self):
        """What tasks need, without the session."""
        return self.spark.sparkContext.broadcast((self.cells, self.dims, self.greatest, self.to))

    def _with_cells(self, data: DataFrame) -> DataFrame:
        shared = self._parts()

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, dims, greatest, to = shared.value
            for b in batches:
                x = _matrix(b.column("embedding"), dims)
                wide = np.sqrt(np.maximum(greatest - (x * x).sum(axis=1), 0))
                cell = cells.of(np.column_stack((x, wide)) @ to)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cell)], names=["vec_id", "embedding", "cell"])

        return checkpoint(data.select("vec_id", "embedding").mapInArrow(put, "vec_id long, embedding array<double>, cell long"))

    def _boxes(self, data_rows: int) -> None:
        """Number of rows and bounding box of each cell; cells of more than `data_rows` rows are dealt
        to several blocks by a hash, so that many equal vectors do not fill one."""
        shared = self._parts()

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, dims, greatest, to = shared.value
            boxes: dict[int, list] = {}
            for b in batches:
                x, cell = _matrix(b.column("embedding"), dims), b.column("cell").to_numpy()
                wide = np.sqrt(np.maximum(greatest - (x * x).sum(axis=1), 0))
                at = np.column_stack((x, wide)) @ to
                order = np.argsort(cell, kind="stable")
                start = np.flatnonzero(np.diff(cell[order], prepend=-1))
                for c, low, high, n in zip(cell[order][start].tolist(), np.minimum.reduceat(at[order], start), np.maximum.reduceat(at[order], start), np.diff(np.append(start, len(cell))).tolist(), strict=True):
                    had = boxes.get(c)
                    boxes[c] = [np.minimum(had[0], low), np.maximum(had[1], high), had[2] + n] if had else [low, high, n]
            if boxes:
                rows = [(c, a, float(lo), float(hi), n) for c, (low, high, n) in boxes.items() for a, (lo, hi) in enumerate(zip(low, high, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["cell", "axis", "low", "high", "n"])

        sides = self.data.mapInArrow(measure, "cell long, axis long, low double, high double, n long")
        table = sides.groupBy("cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("cell", "axis").toArrow()
        m = self.to.shape[1]
        self.cell = table["cell"].to_numpy()[::m]
        self.low, self.high = (table[c].to_numpy().reshape(-1, m) for c in ("low", "high"))
        self.parts = -(-table["n"].to_numpy()[::m] // data_rows)
        self.first = np.cumsum(self.parts) - self.parts

    def _blocks(self) -> DataFrame:
        """The data with their block."""
        to = self.spark.createDataFrame(list(zip(self.cell.tolist(), self.first.tolist(), self.parts.tolist(), strict=True)), "cell long, first long, parts long")
        return self.data.join(F.broadcast(to), "cell").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"), "vec_id", "embedding")

    def routed(self, asked: DataFrame, all_cells: bool) -> DataFrame:
        """query_id, embedding, bound and block: one block of the nearest cell, or every block of the
        cells that the test demands at the bound."""
        shared = self.spark.sparkContext.broadcast((self.low, self.high, self.parts, self.first, self.to, self.dims, self.greatest, self.limit))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, parts, first, to, dims, greatest, limit = shared.value
            step = max(1, 4_000_000 // len(low))
            for whole in batches:
                for i in range(0, whole.num_rows, step):
                    b = whole.slice(i, step)
                    x, bound = _matrix(b.column("embedding"), dims), b.column("bound").to_numpy(zero_copy_only=False)
                    away = _box_distances(low, high, x @ to[:-1])
                    if all_cells:
                        q, c = np.nonzero(away < limit * np.maximum((x * x).sum(axis=1) + greatest - 2 * bound, 1e-9)[:, None])
                        n = parts[c]
                    else:
                        q, c = np.arange(len(x)), away.argmin(axis=1)
                        n = np.ones(len(x), dtype=np.int64)
                    block = np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    q = np.repeat(q, n)
                    for j in range(0, len(q), 5000):
                        own = b.take(pa.array(q[j : j + 5000]))
                        yield pa.RecordBatch.from_arrays([pa.array(block[j : j + 5000]), *own.columns], names=["block", *own.schema.names])

        return asked.select("vec_id", "embedding", "bound").mapInArrow(route, "block long, vec_id long, embedding array<double>, bound double")

    def found(self, asked: DataFrame) -> DataFrame:
        """Answers of the blocks to routed queries (see _RESULT). A block's vectors come before its
        queries, which pass through in batches; a block that more than `query_rows` queries
        want is there several times."""
        parts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / self.query_rows).cast("long").alias("_parts")).where("_parts > 1")
        data = self._blocks().join(parts, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)))
        queries = asked.join(parts, "block", "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("_parts", F.lit(1).cast("long"))))
        columns = ["block", "part", "kind", "vec_id", "embedding", "bound"]
        both = data.withColumns({"kind": F.lit(0), "bound": F.lit(None).cast("double")}).select(*columns).unionAll(queries.withColumn("kind", F.lit(1)).select(*columns))
        shared, k, leaf, limit = self._parts(), self.k, self.leaf, self.limit

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, dims, greatest, to = shared.value
            key, held, block = None, [], None
            for b in batches:
                keys, kind = np.column_stack((b.column("block").to_numpy(), b.column("part").to_numpy())), b.column("kind").to_numpy()
                change = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(kind) != 0)) + 1
                for i, j in zip([0, *change.tolist()], [*change.tolist(), len(kind)], strict=True):
                    own = b.slice(i, j - i)
                    if j == i:
                        continue
                    if key != tuple(keys[i]):
                        key, held, block = tuple(keys[i]), [], None
                    if not kind[i]:
                        held.append((own.column("vec_id").to_numpy(), _matrix(own.column("embedding"), dims)))
                        continue
                    if block is None:
                        if not held:
                            continue
                        block, held = Block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), greatest, to, leaf), []
                    ids, asked, bound = own.column("vec_id").to_numpy(), _matrix(own.column("embedding"), dims), own.column("bound").to_numpy(zero_copy_only=False)
                    for q in range(0, len(ids), 512):
                        yield _answers(block, key[0], ids[q : q + 512], asked[q : q + 512], bound[q : q + 512], k, limit)

        return both.repartition("block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(run, _RESULT)

    def answers(self) -> DataFrame:
        """Answers of all blocks that a query demands. The second round's test may pass over points that
        gave the bound, so those of the first round are answers too."""
        first = checkpoint(self.found(checkpoint(self.routed(self.asked.withColumn("bound", F.lit(float("-inf"))), False))))
        per = first.groupBy("query_id").agg(F.min("score").alias("_least"), F.count("vec_id").alias("_n"))
        bound = F.when(F.col("_n") >= self.k, F.col("_least")).otherwise(float("-inf"))
        bounded = self.asked.join(per, self.asked["vec_id"] == per["query_id"], "left").withColumn("bound", F.coalesce(bound, F.lit(float("-inf"))))
        return self.found(checkpoint(self.routed(bounded, True))).withColumn("round", F.lit(2)).unionByName(first.withColumn("round", F.lit(1)))


def _clean(frame: DataFrame) -> DataFrame:
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, m: int = 24, sure: float = 0.9, leaf: int = 64, data_rows: int = 65536, query_rows: int = 262144, sample_rows: int = 32768, most_cells: int = 65536) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product, double) of the k nearest found.

    Both inputs have vec_id and embedding (array of numbers). Rows with a null vec_id and
    vectors that are null, zero or hold null or non-finite components take no part; nor do
    vectors of another length than the most frequent one (the shorter on a tie). Of several
    rows with one vec_id the greatest vector counts. A query's own vec_id is no candidate.
    Ties go to the smaller vec_id. With fewer than k candidates all come back. Other columns are
    left out, whatever their names; an empty table gives no rows.

    Each query gets k answers, or all candidates if they are fewer: those of its nearest cell count with the rest.
    The upper tree is split by about `sample_rows` rows and has at most `most_cells` cells, so that
    its boxes (broadcast) take some 25 MB at most; every row is in a cell.
    """
    search = _Search(vectors, queries, k, m, sure, leaf, data_rows, query_rows, sample_rows, most_cells)
    if not search.rows:
        return search.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = search.answers().where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a point may be found twice
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def verified_share(vectors: DataFrame, queries: DataFrame, **options) -> float:
    """Share of all pairs of a query and a vector whose inner product nearest() computes in its second round."""
    defaults = dict(k=20, m=24, sure=0.9, leaf=64, data_rows=65536, query_rows=262144, sample_rows=32768, most_cells=65536)
    search = _Search(vectors, queries, **defaults | options)
    per = search.answers().where("round = 2").groupBy("query_id", "block").agg(F.max("verified").alias("v"))
    return (per.agg(F.sum("v")).first()[0] or 0) / max(1, search.rows * search.asked.count())


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))

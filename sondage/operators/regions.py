"""Regions that were found in a document turned four ways, united in the document's own frame.

Regions are mapped back to the frame, a margin around each; what overlaps or touches is one region, whose text is
that of the part with the most visible cells. Where regions overlap those of the earlier rotation are
seen, and within a rotation the later ones. A document of few regions moves once and is united where it lies, from
the pairs of its regions. In larger documents overlaps are looked for within square tiles, to which regions are dealt:
a document of any number of regions is spread over its tiles, and a tile paints its regions one after
another into one small array, whatever their number. Tiles give links and visible cells; connected components make the regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint
from .components import components


def mapped(regions: DataFrame, margin: int = 3) -> DataFrame:
    """`regions` with x0, y0, x1 and y1: the first and last column and row, in the frame of the document, of a region
    (rotation, x, y, w, h) of the document (width, height) turned clockwise by `rotation` quarters. The margin is cut at
    the frame; a region outside of it goes, as one with an unknown rotation or a null in it."""
    r, width, height = F.col("rotation"), F.col("width"), F.col("height")
    across = F.when(r % 2 == 1, height).otherwise(width)
    down = F.when(r % 2 == 1, width).otherwise(height)
    a, b = F.greatest(F.col("x") - margin, F.lit(0)), F.least(F.col("x") + F.col("w") + margin, across - 1)
    c, d = F.greatest(F.col("y") - margin, F.lit(0)), F.least(F.col("y") + F.col("h") + margin, down - 1)
    by = lambda *v: F.when(r == 0, v[0]).when(r == 1, v[1]).when(r == 2, v[2]).when(r == 3, v[3])
    out = regions.where((a <= b) & (c <= d) & r.between(0, 3))
    return out.withColumns({"x0": by(a, c, width - 1 - b, width - 1 - d), "x1": by(b, d, width - 1 - a, width - 1 - c), "y0": by(c, height - 1 - b, height - 1 - d, a), "y1": by(d, height - 1 - a, height - 1 - c, b)})


def _tiles(placed: DataFrame, doc: str, tile: int) -> DataFrame:
    """doc, a, b and cells: links of regions that touch (b) and visible cells of a region in a tile (b null)."""
    span = lambda low, high: F.sequence((F.col(low) / tile).cast("int"), ((F.col(high) + 1) / tile).cast("int"))  # noqa: E731  a cell more, so that neighbours meet
    dealt = placed.select(doc, "id", "rotation", "x0", "y0", "x1", "y1", F.explode(span("x0", "x1")).alias("tx")).select(doc, "id", "rotation", "x0", "y0", "x1", "y1", "tx", F.explode(span("y0", "y1")).alias("ty"))
    together = dealt.repartition(doc, "tx", "ty").sortWithinPartitions(doc, "tx", "ty", F.desc("rotation"), "id")
    kind, name = dict(placed.dtypes)[doc], dict(placed.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], ([], [], [], [])
        seen, joined = np.zeros((tile, tile), np.int64), np.zeros((tile + 1, tile + 1), np.int64)

        def tell(d, a, b, n) -> None:
            for column, value in zip(out, (d, a, b, n), strict=True):
                column.append(value)

        def end() -> None:
            if key is not None:
                which, cells = np.unique(seen[seen > 0], return_counts=True)
                for k, n in zip(which.tolist(), cells.tolist(), strict=True):
                    tell(key[0], ids[k - 1], None, n)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], schema.field(0).type), pa.array(out[1], schema.field(1).type), pa.array(out[2], schema.field(1).type), pa.array(out[3], pa.int64())], names=[doc, "a", "b", "cells"])
            for column in out:
                column.clear()
            return made

        schema = None
        for b in batches:
            schema = schema or b.schema
            columns = [b.column(c).to_pylist() for c in (doc, "id", "tx", "ty", "x0", "y0", "x1", "y1")]
            for d, i, tx, ty, x0, y0, x1, y1 in zip(*columns, strict=True):
                if key != (d, tx, ty):
                    end()
                    key, ids = (d, tx, ty), []
                    seen[:], joined[:] = 0, 0
                ids.append(i)
                # the array of links begins a cell before the tile
                left, top, right, low = x0 - tx * tile, y0 - ty * tile, x1 - tx * tile, y1 - ty * tile
                around = joined[max(top, 0) : low + 3, max(left, 0) : right + 3]
                for k in np.unique(around[around > 0]).tolist():
                    tell(d, i, ids[k - 1], None)
                    joined[joined == k] = len(ids)
                joined[max(top + 1, 0) : max(low + 2, 0), max(left + 1, 0) : max(right + 2, 0)] = len(ids)
                seen[max(top, 0) : max(low + 1, 0), max(left, 0) : max(right + 1, 0)] = len(ids)
                if len(out[0]) > 4000:
                    yield batch()
        end()
        if out[0]:
            yield batch()

    return together.select(doc, "id", "tx", "ty", "x0", "y0", "x1", "y1").mapInArrow(run, f"{doc} {kind}, a {name}, b {name}, cells long")


def _groups(sizes: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, ids: list) -> np.ndarray:
    """The first row of those that each row is one region with; `sizes` are the numbers of rows of the documents, one after another."""
    rows = np.arange(len(x0))
    later = np.repeat(np.cumsum(sizes), sizes) - rows - 1
    a = np.repeat(rows, later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    meet = (x0[a] <= x1[b] + 1) & (x0[b] <= x1[a] + 1) & (y0[a] <= y1[b] + 1) & (y0[b] <= y1[a] + 1)
    if len(set(ids)) < len(ids):  # rows of one id are one part
        meet |= np.fromiter((ids[i] == ids[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
    a, b = a[meet], b[meet]
    root = rows
    while (root[a] != root[b]).any():
        low, new = np.minimum(root[a], root[b]), root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        root = new
    return root


def _visible(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Cells of each region that no later one covers, on the grid of all their edges."""
    xs, ys = np.unique(np.concatenate((x0, x1 + 1))), np.unique(np.concatenate((y0, y1 + 1)))
    seen = np.full((len(ys) - 1, len(xs) - 1), -1, np.int32)
    edges = [np.searchsorted(*at).tolist() for at in ((ys, y0), (ys, y1 + 1), (xs, x0), (xs, x1 + 1))]
    for k, (top, low, left, right) in enumerate(zip(*edges, strict=True)):
        seen[top:low, left:right] = k
    cells = np.diff(ys)[:, None] * np.diff(xs)
    return np.bincount(seen.ravel() + 1, cells.ravel(), len(x0) + 1)[1:].astype(np.int64)


def _whole(placed: DataFrame, doc: str, keep: tuple[str, ...], pairs: int = 1 << 20) -> DataFrame:
    """The united regions of documents of few regions. Documents come one after another; those of about `pairs` pairs
    of regions are united at once."""
    together = placed.repartition(doc).sortWithinPartitions(doc, F.desc("rotation"), "id")
    side = lambda a, b: (F.col(b) - F.col(a) + 1)
    schema = placed.select(doc, "id", F.col("x0").alias("x"), F.col("y0").alias("y"), side("x0", "x1").alias("w"), side("y0", "y1").alias("h"), F.lit(0).cast("long").alias("n"), *keep).schema

    def unite(b: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        x0, y0, x1, y1 = (b.column(c).to_numpy().astype(np.int64) for c in ("x0", "y0", "x1", "y1"))
        ids = b.column("id").to_pylist()
        # ids are compared within a document alone
        named = list(zip(np.repeat(np.arange(len(sizes)), sizes).tolist(), ids, strict=True))
        root = _groups(sizes, x0, y0, x1, y1, named)
        order = np.argsort(root, kind="stable")
        firsts, at, n = np.unique(root[order], return_index=True, return_counts=True)
        best = firsts.copy()
        for k in np.flatnonzero(n > 1).tolist():
            own = order[at[k] : at[k] + n[k]]
            cells = _visible(x0[own], y0[own], x1[own], y1[own]).tolist()
            sums = {}
            for i, c in zip(own.tolist(), cells, strict=True):
                sums[ids[i]] = sums.get(ids[i], 0) + c
            best[k] = min(own.tolist(), key=lambda i: (-sums[ids[i]], ids[i]))
        edge = lambda f, v: f.reduceat(v[order], at)
        x, y, right, low = edge(np.minimum, x0), edge(np.minimum, y0), edge(np.maximum, x1), edge(np.maximum, y1)
        chosen = b.take(pa.array(best))
        numbers = [pa.array(v).cast(b.column(c).type) for v, c in ((x, "x0"), (y, "y0"), (right - x + 1, "x1"), (low - y + 1, "y1"))]
        return pa.RecordBatch.from_arrays([chosen.column(doc), chosen.column("id"), *numbers, pa.array(n.astype(np.int64)), *[chosen.column(c) for c in keep]], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(b: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
            first = start = count = 0
            for k, size in enumerate(sizes):
                count += size * size
                if count >= pairs or k + 1 == len(sizes):
                    own = np.array(sizes[first : k + 1])
                    yield unite(b.slice(start, int(own.sum())), own)
                    first, start, count = k + 1, start + int(own.sum()), 0

        rest = None
        for b in batches:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0] if rest is not None and rest.num_rows else b
            keys = b.column(doc).to_pylist()
            bounds = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]]
            yield from ready(b, [q - p for p, q in zip(bounds, bounds[1:], strict=False)])
            rest = b.slice(bounds[-1])  # the next batch may have more of the last document
        if rest is not None and rest.num_rows:
            yield from ready(rest, [rest.num_rows])

    return together.mapInArrow(run, schema)


def united(regions: DataFrame, doc: str = "doc", margin: int = 3, tile: int = 64, keep: tuple[str, ...] = ("texto",), most: int = 1000) -> DataFrame:
    """doc, id, x, y, w, h, n and `keep` of the united regions.

    `regions` have doc, id (unique in a document, in the order of rotation and place), rotation (quarters
    clockwise, 0 to 3), x, y, w, h in the turned document, width and height of the unturned one, and the columns of
    `keep`. A united region has the box around its n parts; id and `keep` are those of the part with the most
    visible cells among them, the smaller id on a tie. A document of more than `most` regions is united by tiles.
    """
    placed = mapped(regions.where(F.col(doc).isNotNull() & F.col("id").isNotNull()), margin).select(doc, "id", "rotation", "x0", "y0", "x1", "y1", *keep)
    large = checkpoint(placed.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(doc))
    if large.isEmpty():
        return _whole(placed, doc, keep)
    return _whole(placed.join(large, doc, "left_anti"), doc, keep).unionByName(_by_tiles(placed.join(large, doc, "left_semi"), doc, tile, keep))


def _by_tiles(placed: DataFrame, doc: str, tile: int, keep: tuple[str, ...]) -> DataFrame:
    """The united regions of documents of any number of regions."""
    placed = checkpoint(placed)
    parts = checkpoint(_tiles(placed, doc, tile))
    node = lambda c: F.struct(F.col(doc).alias("d"), F.col(c).alias("i"))
    links = parts.where("b is not null").select(node("a").alias("u"), node("b").alias("v"))
    roots = components(links).select(F.col("u.d").alias(doc), F.col("u.i").alias("id"), F.col("v.i").alias("_root"))
    cells = parts.where("b is null").groupBy(doc, F.col("a").alias("id")).agg(F.sum("cells").alias("_cells"))
    met = placed.join(roots, [doc, "id"], "left").join(cells, [doc, "id"], "left").withColumn("_root", F.coalesce("_root", "id"))
    best = F.min_by(F.struct("id", *keep), F.struct(-F.coalesce("_cells", F.lit(0)), "id")).alias("_best")
    out = met.groupBy(doc, "_root").agg(best, F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"), F.count(F.lit(1)).alias("n"))
    return out.select(doc, "_best.id", "x", "y", (F.col("_x1") - F.col("x") + 1).alias("w"), (F.col("_y1") - F.col("y") + 1).alias("h"), "n", *[F.col("_best")[c].alias(c) for c in keep])

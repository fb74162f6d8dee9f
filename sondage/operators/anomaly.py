"""Statistics of feature vectors and of grids of patch vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import dot


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector over its length; lengths under 1e-12 count as that."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v.cast("array<double>"), lambda x: x / n)


def concat_vectors(*vectors: Column) -> Column:
    """One array of several; null if any is null."""
    return F.concat(*[v.cast("array<double>") for v in vectors])


def standardize(rows: DataFrame, key: str, vector: str, train: Column | None = None) -> DataFrame:
    """key and `z`: each component less its mean, over its population deviation (1 where that is
    0), both from the rows for which `train` holds.

    Means and deviations come from one aggregation by position; the table of them has a row
    for each dimension and is joined back as one array.
    """
    use = rows if train is None else rows.where(train)
    cells = use.select(F.posexplode(F.col(vector).cast("array<double>")).alias("_i", "_x"))
    stats = cells.groupBy("_i").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    table = stats.agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_t"))
    z = F.zip_with(F.col(vector).cast("array<double>"), F.col("_t"), lambda x, t: (x - t["_m"]) / F.when(t["_s"] == 0, 1.0).otherwise(t["_s"]))
    return rows.crossJoin(F.broadcast(table)).select(key, z.alias("z"))


def _grid(table: pa.Table, side: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and unit vectors of one image's patches, in the order of (i, j)."""
    i, j = table["i"].to_numpy(), table["j"].to_numpy()
    order = np.lexsort((j, i))
    v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(i), -1)[order]
    if side is not None and (len(i) != side * side or (i[order] != np.repeat(np.arange(side), side)).any() or (j[order] != np.tile(np.arange(side), side)).any()):
        raise ValueError("patches are no full grid")
    return i[order], j[order], v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _apart(unit: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return 1 - (unit * (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12))).sum(axis=1)


def _local(unit: np.ndarray, side: int) -> np.ndarray:
    grid = np.pad(unit.reshape(side, side, -1), ((1, 1), (1, 1), (0, 0)), mode="edge")
    near = sum(grid[1 + a : 1 + a + side, 1 + b : 1 + b + side] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
    return _apart(unit, near.reshape(side * side, -1) / 8)


def _global(unit: np.ndarray) -> np.ndarray:
    return _apart(unit, unit.mean(axis=0, keepdims=True))


def _by_image(patches: DataFrame, img: str, run, schema: str) -> DataFrame:
    """`run` over each image's patches, which meet in one shuffle; an image's grid fits in a task."""
    kind = dict(patches.dtypes)[img]
    rows = patches.select(img, "i", "j", F.col("v").cast("array<double>").alias("v"))
    return rows.groupBy(img).applyInArrow(lambda t: run(t), f"{img} {kind}, {schema}")


def local_deviation(patches: DataFrame, side: int, img: str = "img") -> DataFrame:
    """img, i, j, dev: one less the cosine between each patch and the mean of its eight neighbours.

    `patches` has img, i, j and v, a full grid of side x side for each image. Beyond the border the
    nearest patch stands in, so at a border a patch may be among its own neighbours.
    """

    def run(t: pa.Table) -> pa.Table:
        i, j, unit = _grid(t, side)
        return pa.table({img: t[img], "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "dev": _local(unit, side)})

    return _by_image(patches, img, run, "i int, j int, dev double")


def global_deviation(patches: DataFrame, img: str = "img") -> DataFrame:
    """img, i, j, dev: one less the cosine between each patch and its image's mean patch."""

    def run(t: pa.Table) -> pa.Table:
        i, j, unit = _grid(t, None)
        return pa.table({img: t[img], "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "dev": _global(unit)})

    return _by_image(patches, img, run, "i int, j int, dev double")


STATS = ("max", "p99", "p95", "media", "desvio", "pico_media")


def summarize(devs: DataFrame, img: str = "img", prefix: str = "") -> DataFrame:
    """img and six statistics of its deviations; the deviation is that of a sample."""
    top, mean = F.max("dev"), F.avg("dev")
    columns = [top, F.percentile("dev", F.lit(0.99)), F.percentile("dev", F.lit(0.95)), mean, F.stddev_samp("dev"), top / (mean + 1e-6)]
    return devs.groupBy(img).agg(*[c.alias(f"{prefix}{s}") for c, s in zip(columns, STATS, strict=True)])


def anomaly_vector(patches: DataFrame, side: int, img: str = "img") -> DataFrame:
    """img and twelve statistics: six of the local and six of the global deviations.

    An image whose patches are no full grid of side * side is an error.
    """

    def six(dev: np.ndarray) -> list[float]:
        spread = dev.std(ddof=1) if len(dev) > 1 else float("nan")
        return [dev.max(), np.quantile(dev, 0.99), np.quantile(dev, 0.95), dev.mean(), spread, dev.max() / (dev.mean() + 1e-6)]

    names = [f"{kind}_{s}" for kind in ("local", "global") for s in STATS]

    def run(t: pa.Table) -> pa.Table:
        _, _, unit = _grid(t, side)
        values = six(_local(unit, side)) + six(_global(unit))
        return pa.table({img: t[img][:1]} | {n: pa.array([float(v)]) for n, v in zip(names, values, strict=True)})

    return _by_image(patches, img, run, ", ".join(f"{n} double" for n in names))


def boundary_ratio(v: Column, period: int = 8) -> Column:
    """Mean absolute step at every `period`-th boundary of a vector over its mean absolute step."""
    x = v.cast("array<double>")
    steps = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda k: F.struct(k.alias("k"), F.abs(F.get(x, k) - F.get(x, k - 1)).alias("d")))
    edge = F.filter(steps, lambda s: s["k"] % period == 0)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e["d"]) / F.greatest(F.size(a), F.lit(1))
    return mean(edge) / (mean(steps) + 1e-6)


#: Statistics of a raster, in the order of raster_statistics().
RASTER = ("media", "desvio", "laplaciano", "alta_frequencia", "blocagem", "ruido")


def _mirrored(x: np.ndarray, by: int) -> np.ndarray:
    """Rasters with a border of their own cells, mirrored at the outermost ones."""
    return np.pad(x, ((0, 0), (by, by), (by, by)), mode="reflect")


def _steps(x: np.ndarray, axis: int, period: int) -> np.ndarray:
    d = np.abs(np.diff(x, axis=axis))
    edge = np.take(d, np.arange(period - 1, d.shape[axis], period), axis=axis)
    at_edges = edge.mean(axis=(1, 2)) if edge.shape[axis] else np.zeros(len(x))
    return at_edges / (d.mean(axis=(1, 2)) + 1e-6)


def rasters(x: np.ndarray, period: int = 8) -> np.ndarray:
    """RASTER of square rasters (n x side x side), n x 6."""
    side = x.shape[1]
    wide = _mirrored(x, 1)
    laplace = wide[:, :-2, 1:-1] + wide[:, 2:, 1:-1] + wide[:, 1:-1, :-2] + wide[:, 1:-1, 2:] - 4 * x
    size = np.abs(np.fft.fftshift(np.fft.fft2(x), axes=(1, 2)))
    at = np.arange(side) - side // 2
    far = at[:, None] ** 2 + at[None] ** 2 > (60 * side / 256) ** 2
    reach = min(4, side - 1)
    bell = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2)
    bell /= bell.sum()
    blurred = _mirrored(x, reach)
    for axis in (1, 2):
        blurred = np.apply_along_axis(np.convolve, axis, blurred, bell, mode="valid")
    columns = [
        x.mean(axis=(1, 2)), x.std(axis=(1, 2)), laplace.var(axis=(1, 2)), (size * far).sum(axis=(1, 2)) / (size.sum(axis=(1, 2)) + 1e-6),
        (_steps(x, 1, period) + _steps(x, 2, period)) / 2, np.median(np.abs(x - blurred), axis=(1, 2)),
    ]
    return np.column_stack(columns)


def raster_statistics(rows: DataFrame, key: str, vector: str, side: int, period: int = 8) -> DataFrame:
    """key and RASTER of each vector, read as a grey raster of side * side cells, row by row: mean and population
    deviation, variance of the Laplacian, share of the Fourier magnitudes further than 60/256 of the side from the
    middle, steps at every `period`-th boundary over all steps (mean of both directions), and the median of what a Gaussian
    blur of deviation 1 takes away. Borders are mirrored. A null vector and one of another length have null statistics.
    One narrow pass in Arrow batches."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                own = b.slice(i, 2048)
                values, good = own.column("v"), np.asarray(own.column("ok"))
                out = np.zeros((own.num_rows, len(RASTER)))
                if good.any():
                    x = values.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side)
                    out[good] = rasters(x, period)
                yield pa.RecordBatch.from_arrays([own.column(key), *[pa.array(c, mask=~good) for c in out.T]], names=[key, *RASTER])

    v = F.col(vector).cast("array<double>")
    whole = F.coalesce((F.size(v) == side * side) & F.forall(v, lambda x: x.isNotNull()), F.lit(False))
    return rows.select(key, v.alias("v"), whole.alias("ok")).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} double" for c in RASTER))

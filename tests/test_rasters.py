"""Statistics of rasters against sums written out."""

import cmath
import math
import statistics

import numpy as np
import pytest

from sondage.operators import anomaly


def plain(x, period):
    n = len(x)
    cells = [x[i][j] for i in range(n) for j in range(n)]
    mirror = lambda i: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    at = lambda i, j: x[mirror(i)][mirror(j)]
    laplace = [at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * x[i][j] for i in range(n) for j in range(n)]
    size = {(u, v): abs(sum(x[i][j] * cmath.exp(-2j * math.pi * (u * i + v * j) / n) for i in range(n) for j in range(n))) for u in range(n) for v in range(n)}
    place = lambda u: u if u < n - n // 2 else u - n
    far = sum(s for (u, v), s in size.items() if place(u) ** 2 + place(v) ** 2 > (60 * n / 256) ** 2)
    rows = [[abs(x[i + 1][j] - x[i][j]) for j in range(n)] for i in range(n - 1)]
    columns = [[abs(x[i][j + 1] - x[i][j]) for i in range(n)] for j in range(n - 1)]
    ratio = lambda d: (statistics.fmean([y for r in d[period - 1 :: period] for y in r]) if d[period - 1 :: period] else 0) / (statistics.fmean([y for r in d for y in r]) + 1e-6)
    reach = min(4, n - 1)
    bell = {k: math.exp(-k * k / 2) for k in range(-reach, reach + 1)}
    total = sum(bell.values()) ** 2
    noise = [abs(x[i][j] - sum(bell[a] * bell[b] * at(i + a, j + b) for a in bell for b in bell) / total) for i in range(n) for j in range(n)]
    return [statistics.fmean(cells), statistics.pstdev(cells), statistics.pvariance(laplace), far / (sum(size.values()) + 1e-6), (ratio(rows) + ratio(columns)) / 2, statistics.median(noise)]


@pytest.mark.parametrize(("side", "period"), [(8, 8), (8, 4), (12, 8), (5, 2)])
def test_rasters(spark, side, period):
    rng = np.random.default_rng(side + period)
    x = rng.standard_normal((6, side, side)) + np.linspace(0, 3, side)
    x[5] = 1.0
    rows = [(i, v.ravel().tolist()) for i, v in enumerate(x)] + [(6, None), (7, [1.0, 2.0]), (8, [None] * side * side)]
    got = {r[0]: r[1:] for r in anomaly.raster_statistics(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), "id", "v", side, period).collect()}
    for i in range(6):
        assert got[i] == pytest.approx(plain(x[i].tolist(), period), abs=1e-9)
    assert all(got[i] == (None,) * 6 for i in (6, 7, 8))
    assert anomaly.raster_statistics(spark.createDataFrame(rows[:0], "id long, v array<double>"), "id", "v", side).count() == 0

"""United regions against painted documents."""

import random

import numpy as np
import pytest

from sondage.operators import regions

W, H = 90, 70


def painted(rows, margin):
    """Turn each region by turning a painted document; label the touching ones; count visible cells."""
    seen, parts = np.zeros((H, W), int), []
    for r in range(4):
        turned = np.rot90(np.zeros((H, W), int), -r).copy()
        solo = []
        for k, (_, i, rotation, x, y, w, h) in enumerate(rows):
            if rotation == r:
                top, left = max(y - margin, 0), max(x - margin, 0)
                if left > min(x + w + margin, turned.shape[1] - 1) or top > min(y + h + margin, turned.shape[0] - 1):
                    continue
                turned[top : y + h + margin + 1, left : x + w + margin + 1] = k + 1
                own = np.zeros_like(turned)
                own[top : y + h + margin + 1, left : x + w + margin + 1] = 1
                solo.append((k, np.rot90(own, r)))
        back = np.rot90(turned, r)
        seen = np.where(seen == 0, back, seen)
        parts += solo
    grown = {}
    for k, m in parts:
        g = np.zeros((H + 2, W + 2), int)
        for dy in range(3):
            for dx in range(3):
                g[dy : dy + H, dx : dx + W] |= m
        grown[k] = g[1:-1, 1:-1]
    root = {k: k for k, _ in parts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, m in parts:
        for j, n in parts:
            if (grown[k] & n).any():
                root[find(k)] = find(j)
    out = {}
    for k, m in parts:
        out.setdefault(find(k), []).append((k, m))
    got = set()
    for own in out.values():
        ys, xs = np.nonzero(sum(m for _, m in own))
        best = min(own, key=lambda p: (-(seen == p[0] + 1).sum(), rows[p[0]][1]))[0]
        got.add((rows[best][1], int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1), len(own)))
    return got


@pytest.mark.parametrize(("seed", "margin", "tile"), [(1, 3, 16), (2, 0, 16), (3, 1, 64), (4, 3, 7)])
def test_united_regions_are_painted_ones(spark, seed, margin, tile):
    rng = random.Random(seed)
    rows, want = [], {}
    for doc in range(8):
        own = []
        for i in range(rng.choice([1, 4, 12, 25])):
            r = rng.randint(0, 3)
            own.append((doc, f"{r}:{i:03d}", r, rng.randint(-4, 95), rng.randint(-4, 85), rng.randint(0, 14), rng.randint(0, 9)))
        own.sort(key=lambda x: x[1])
        want[doc] = painted(own, margin)
        rows += own
    frame = spark.createDataFrame([(*r, W, H, f"t{r[1]}") for r in rows], "doc int, id string, rotation int, x int, y int, w int, h int, width int, height int, texto string").repartition(5)
    got = {}
    for r in regions.united(frame, margin=margin, tile=tile).collect():
        got.setdefault(r["doc"], set()).add((r["id"], r["x"], r["y"], r["w"], r["h"], r["n"]))
        assert r["texto"] == f"t{r['id']}"
    assert got == {d: v for d, v in want.items() if v}


@pytest.mark.parametrize("most", [0, 4, 12])
def test_few_and_many_regions_give_the_same(spark, most):
    rng = random.Random(most)
    rows = [(doc, f"{i % 4}:{i:03d}", i % 4, rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 14), rng.randint(0, 9), W, H, f"t{i}") for doc in range(30) for i in range(rng.choice([1, 4, 5, 12, 13, 40]))]
    frame = spark.createDataFrame(rows, "doc long, id string, rotation int, x int, y int, w int, h int, width int, height int, texto string").repartition(3)
    want = sorted(map(tuple, regions.united(frame).collect()))
    assert sorted(map(tuple, regions.united(frame, most=most).collect())) == want and sum(r[6] for r in want) == len(rows)


def test_few_regions_move_once(spark, tmp_path):
    """Copies for tiles, checkpoints of rows and joins of links would each move a small document again."""
    rows = [(doc, f"{i % 4}:{i}", i % 4, 0, 0, 500, 300, 1300, 900, "t") for doc in range(50) for i in range(5)]
    spark.createDataFrame(rows, "doc long, id string, rotation int, x int, y int, w int, h int, width int, height int, texto string").write.parquet(str(tmp_path / "in"))
    plan = regions.united(spark.read.parquet(str(tmp_path / "in")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Join" not in plan and "FileScan" in plan


def test_no_regions(spark):
    frame = spark.createDataFrame([], "doc int, id string, rotation int, x int, y int, w int, h int, width int, height int, texto string")
    assert regions.united(frame).count() == 0

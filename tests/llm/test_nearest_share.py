"""Nearest neighbours: how much is verified, ties, many equal vectors, columns of the same names."""

import numpy as np
from pyspark.sql import functions as F

from sondage.llm import ann


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def answers(frame):
    got = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def brute(x, q, k):
    s = x @ x[q]
    return [(int(i), float(s[i])) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]


def test_clustered_vectors_are_verified_in_part(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] + 0.35 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = table(spark, x).withColumns({c: F.lit(1) for c in ("block", "cell", "score", "query_id", "rank", "part")})
    queries = rows.where("vec_id % 20 = 0")
    got = answers(ann.nearest(rows, queries, data_rows=700, query_rows=50))
    right = sum(len({i for i, _ in got[q]} & {i for i, _ in brute(x, q, 20)}) for q in range(0, 6000, 20))
    assert right >= 0.9 * 20 * 300
    assert ann.verified_share(rows, queries, data_rows=700) < 1 / 3


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, (400, 6)).astype(float)
    x[(x == 0).all(axis=1)] = 1.0
    rows = table(spark, x)
    # every test of the distribution holds at sure = 1, so that the answers are exact
    got = answers(ann.nearest(rows, rows.where("vec_id % 20 = 0"), k=7, sure=1.0, data_rows=60, leaf=16))
    assert got == {q: brute(x, q, 7) for q in range(0, 400, 20)}


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    x[200:700] = x[200]
    rows = table(spark, x)
    got = answers(ann.nearest(rows, rows.where("vec_id in (220, 240, 800)"), k=5, sure=1.0, data_rows=50))
    assert [i for i, _ in got[220]] == [200, 201, 202, 203, 204] and [i for i, _ in got[800]] == [i for i, _ in brute(x, 800, 5)]

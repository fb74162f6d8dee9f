"""Joint training of many models, the network head, greedy folds: against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import evaluation, learning, protocols
from sondage.storage import checkpoint


def alone(x, y, c=1.0):
    """Weights and bias of one logistic regression on standardised vectors, by Newton steps, in the vectors' own units."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    a = np.column_stack((np.ones(len(x)), (x - mean) / sd))
    w, keep = np.zeros(a.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a.T * (p * (1 - p))) @ a + keep, a.T @ (p - y) + keep @ w)
    return w[1:] / sd, w[0] - (w[1:] / sd) @ mean


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(3)
    n, p, keys = 3000, 5, 400
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.standard_normal((n, p)) * [1, 5, 0.1, 1, 1] + 0.6 * y[:, None] + [0, 9, 0, 0, -3]
    part = np.where(y == 1, np.minimum(rng.geometric(0.02, n) - 1, keys - 1), -1)  # the first parts are large
    part[(y == 1) & (rng.random(n) < 0.3)] = 0
    rows = [(int(k), int(c), v.tolist()) for k, c, v in zip(part, y, x)]
    return x, y, part, spark.createDataFrame(rows, "k int, y int, v array<double>").repartition(7)


def test_models_together_are_models_alone(many):
    x, y, part, rows = many
    got = learning.fit_excluding(checkpoint(rows), 400)
    assert got.fitted.all() and got.weights.shape == (5, 400)
    for k in [0, 1, 2, 17, 399]:
        w, b = alone(x[part != k], y[part != k])
        assert np.allclose(got.weights[:, k], w, rtol=1e-5, atol=1e-6) and np.isclose(got.bias[k], b, rtol=1e-5, atol=1e-6)


def test_one_model(many):
    x, y, _, rows = many
    model, loss = evaluation.fit_logistic(rows, "v")
    w, b = alone(x, y)
    z = x @ w + b
    assert np.allclose(model.weights[:, 0], w, rtol=1e-6, atol=1e-8) and np.isclose(model.bias[0], b, rtol=1e-6) and model.fitted.all()
    assert loss[0] == pytest.approx(np.log(2)) and loss[-1] == pytest.approx(np.mean(np.logaddexp(0, z) - y * z), rel=1e-6)


def test_a_part_with_a_class_of_its_own_is_not_fitted(spark):
    rows = spark.createDataFrame([(0, 1, [1.0]), (0, 1, [2.0]), (-1, 0, [0.0]), (-1, 0, [1.0]), (1, 0, [1.0])], "k int, y int, v array<double>")
    assert learning.fit_excluding(rows, 2).fitted.tolist() == [False, True]
    assert learning.fit_excluding(rows.limit(0), 2).fitted.tolist() == [False, False]


def test_one_plan_for_a_thousand_keys(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], f"t{i % 1000}" if i % 3 else None, int(i % 3 > 0), rng.standard_normal(3).tolist()) for i in range(4500)]
    frame = spark.createDataFrame(rows, "id long, fonte string, tecnica string, y int, v array<double>")
    got = protocols.held_out(frame, "v", "tecnica")
    assert got.count() == 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 2  # scores, for the cut points and for the areas
    blocks = protocols.held_out(frame, "v", "tecnica", most_models=400)
    a, b = ({r["tecnica"]: (r["n_pos"], r["n_neg"], round(r["auc"], 6)) for r in f.collect()} for f in (got, blocks))
    assert a == b


def plain_head(x, y, xv, yv, head, epochs, rate=1e-3, decay=1e-4):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z, zv = (x - mean) / sd, (xv - mean) / sd
    w = [head.w1.copy(), head.b1.copy(), head.w2.copy(), head.b2.copy()]
    m, v, losses, held = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], [], []
    cross = lambda o, t: float(np.mean(np.log1p(np.exp(-np.abs(o))) + np.maximum(o, 0) - t * o))
    out = lambda q: np.maximum(q @ w[0] + w[1], 0) @ w[2] + w[3]
    for t in range(1, epochs + 1):
        h = np.maximum(z @ w[0] + w[1], 0)
        o = h @ w[2] + w[3]
        losses.append(cross(o, y))
        r = (1 / (1 + np.exp(-o)) - y) / len(y)
        back = np.outer(r, w[2]) * (h > 0)
        for i, g in enumerate((z.T @ back, back.sum(axis=0), h.T @ r, np.array([r.sum()]))):
            g = g + decay * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        held.append(cross(out(zv), yv))
    return losses, held, out(zv)


def test_head_against_numpy(spark, many):
    x, y, _, _ = many
    held = np.arange(len(x)) % 5 == 0
    rows = checkpoint(spark.createDataFrame([(int(a), v.tolist(), int(b)) for a, v, b in zip(y, x, held)], "y int, v array<double>, held int").repartition(40))
    heads, losses, held_losses = learning.train_head(rows, hidden=16, epochs=12, dropout=0.0, rate=0.02)
    want = plain_head(x[~held], y[~held], x[held], y[held], learning.new_head(5, 16, 42), 12, rate=0.02)
    assert np.allclose(losses, want[0], rtol=1e-9) and np.allclose(held_losses, want[1], rtol=1e-9)
    assert np.allclose(heads[-1].logits(x[held]), want[2], rtol=1e-7, atol=1e-9)
    scores = learning.head_scores(rows.where("held = 1"), heads, "v", ["y"])
    last = np.sort([r["score"] for r in scores.where("epoca = 12").collect()])
    assert scores.count() == 12 * held.sum() and np.allclose(last, np.sort(1 / (1 + np.exp(-want[2]))), rtol=1e-7)


def test_head_stops_early_and_drops_out(spark, many):
    x, y, _, _ = many
    rng = np.random.default_rng(0)
    noise = checkpoint(spark.createDataFrame([(int(rng.integers(2)), v.tolist(), int(i % 2)) for i, v in enumerate(x[:200])], "y int, v array<double>, held int"))
    heads, losses, held = learning.train_head(noise, hidden=32, epochs=60, dropout=0.0, rate=0.05, patience=3)
    assert len(heads) == len(losses) == len(held) < 60 and min(held) == held[-4]
    one, two = (learning.train_head(noise, hidden=32, epochs=4, dropout=0.5)[1] for _ in range(2))
    assert one == two and one != learning.train_head(noise, hidden=32, epochs=4, dropout=0.0)[1]


def greedy(groups, folds):
    """One group after another, the most uneven first, to the fold with the least mean deviation of class shares."""
    counts = np.array(groups, float)
    share, fold = counts.sum(axis=0), np.zeros((folds, 2))
    for g in counts[np.argsort(-counts.std(axis=1), kind="stable")]:
        best = min(range(folds), key=lambda k: (np.std((fold + np.eye(folds)[k][:, None] * g) / share, axis=0).mean(), fold[k].sum()))
        fold[best] += g
    return fold / share


@pytest.mark.parametrize("seed", range(6))
def test_folds_are_as_even_as_greedy_ones(seed):
    rng = random.Random(seed)
    groups = [((n := rng.randint(1, 6 + 30 * (rng.random() < 0.05))), rng.randint(0, n)) for _ in range(rng.choice([40, 400, 2000]))]
    sizes = {}
    for g in groups:
        sizes[g] = sizes.get(g, 0) + 1
    extra = {(n, p, place): f for n, p, place, f in evaluation.dealt_folds([(n, p, m) for (n, p), m in sizes.items()], 5)}
    fold = np.zeros((5, 2))
    for (n, p), m in sizes.items():
        for at in range(1, m + 1):
            fold[extra.get((n, p, at), at % 5)] += (n - p, p)
    mine, theirs = (f.std(axis=0).mean() for f in (fold / fold.sum(axis=0), greedy([(n - p, p) for n, p in groups], 5)))
    assert mine <= theirs + 1e-3


def test_folds_of_rows(spark, many):
    rows = spark.range(500).select((F.col("id") % 90).alias("g"), (F.hash("id") % 3 == 0).cast("int").alias("y"))
    folded = evaluation.stratified_group_kfold(rows.unionAll(spark.createDataFrame([(None, 1), (None, 0)], "g long, y int")), "g")
    assert evaluation.leak_check(folded, "g").first()["n_leaks"] == 0 and folded.count() == 502
    per = [tuple(r) for r in folded.groupBy("fold").agg(F.count("*"), F.sum("y")).select("count(1)", "sum(y)").collect()]
    assert len(per) == 5 and max(n for n, _ in per) - min(n for n, _ in per) <= 12 and max(p for _, p in per) - min(p for _, p in per) <= 6


def test_training_events_trains_all_models_in_the_same_passes(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        y = int(rng.random() < 0.5)
        rows.append((i, i // 3, "abc"[i % 3], f"t{rng.integers(0, 4)}" if y else None, f"g{i % 2}" if y else "", y, (rng.standard_normal(5) + 0.7 * y + 0.2 * (i % 3)).tolist()))
    frame = checkpoint(spark.createDataFrame(rows, "key long, grupo long, fonte string, tecnica string, gerador string, y int, v array<double>"))
    passes, total = [], learning.total
    monkeypatch.setattr(learning, "total", lambda *a, **b: (passes.append(1), total(*a, **b))[1])
    state = protocols.training_events(frame, "v", "key", "grupo", "r", epochs=6, hidden=8).collect()[1]
    together = len(passes)
    even = checkpoint(evaluation.balance_by_source(frame, "key"))
    mean = lambda f: np.mean([r["auc"] for r in f.collect()])
    for name, key in (("loto", "tecnica"), ("logo", "gerador")):
        assert state[name] == pytest.approx({r[key]: r["auc"] for r in protocols.held_out(even, "v", key).collect()}, abs=1e-9)
    assert state["auc_agrupada"] == pytest.approx(mean(protocols.grouped_cv(even, "v", "grupo")), abs=1e-9)
    assert state["separabilidade_fonte"] == pytest.approx(protocols.separability(even, "v", "grupo"), abs=1e-9)
    # the head, then one fit for the four protocols; alone they take four
    assert together - 8 < (len(passes) - together) / 2


def test_blocks_lie_over_all_cores(spark):
    rows = checkpoint(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "y int, v array<float>").coalesce(1))
    blocks = learning.packed(rows, {"y": F.when(F.col("y") > 0, F.col("y"))}, most=7)
    assert blocks.partitions >= spark.sparkContext.defaultParallelism and (blocks.kind, blocks.p) == ("float32", 2)
    got = learning.total(blocks, lambda x, o: np.array([len(x), x[:, 0].sum(), np.nansum(o["y"]), np.isnan(o["y"]).sum(), len(x) > 7]), 5)
    assert got.tolist() == [100, 4950, 4950, 1, 0]


def test_state_leaves_out_what_no_protocol_takes(spark):
    """Null sources, labels that are neither 0 nor 1, empty keys: as in each protocol alone; and many keys in rounds."""
    rng = np.random.default_rng(2)
    rows = [(i, i // 2, [None, "a", "b"][i % 3], ["", None, "t0", "t1", "t2"][i % 5], "g", [0, 1, 2, None][int(rng.integers(4))], rng.standard_normal(3).tolist()) for i in range(600)]
    frame = checkpoint(spark.createDataFrame(rows, "key long, grupo long, fonte string, tecnica string, gerador string, y int, v array<double>"))
    state = protocols.generator_state(frame, "v", "key", "grupo", balance=False).first()
    assert state["loto"] == pytest.approx({r["tecnica"]: r["auc"] for r in protocols.held_out(frame, "v", "tecnica").collect()}, abs=1e-9)
    assert state["logo"] == {} and state["n_amostras"] == 600
    assert state["auc_agrupada"] == pytest.approx(np.mean([r["auc"] for r in protocols.grouped_cv(frame, "v", "grupo").collect()]), abs=1e-9)
    assert state["separabilidade_fonte"] == pytest.approx(protocols.separability(frame.where("fonte is not null"), "v", "grupo"), abs=1e-9)
    even = protocols._prepared(frame, "v", "grupo", "fonte", "tecnica", "gerador", "y", 5)
    once, rounds = (protocols._areas(even, protocols._blocks(even), "fonte", 5, most) for most in (2048, 5))
    assert all(once[c] == pytest.approx(rounds[c], abs=1e-9) for c in once) and len(once["_technique"]) == 3

"""Training over distributed rows: sums of gradients, many logistic models at once, a network with one hidden layer.

Vectors stay in their partitions, packed as blocks of bytes once. Each step is one job: every partition adds up what its
rows contribute, and the sums meet in a tree. What reaches the driver is as large as the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint

#: What a partition adds up: an array of a fixed size from the vectors (n x p) and other columns of a batch.
Part = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal lengths as rows."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def numbers(rows: DataFrame, vector: str) -> Column:
    """Vectors as floats where they are floats, as doubles otherwise."""
    return F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")


@dataclass
class Blocks:
    """Rows for many passes: thousands to a row of `frame`, which has their vectors (`p` numbers of type `kind` each) and
    each of `names` (doubles, NaN for null) as bytes, so that a pass copies bytes and converts nothing."""

    frame: DataFrame
    names: list[str]
    kind: str
    p: int
    partitions: int


def spread(rows: DataFrame) -> DataFrame:
    """`rows`, from a checkpoint or table, over all cores: what shuffles merged into few partitions by its bytes is little to
    move but long to compute. The order within a partition doesn't depend on how blocks of the shuffle arrive."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores).sortWithinPartitions(F.xxhash64(*rows.columns))


def packed(rows: DataFrame, columns: dict[str, Column], vector: str = "v", partition: tuple[str, ...] = (), most: int = 4096, most_bytes: int = 1 << 22) -> Blocks:
    """`rows`, from a checkpoint or table, as blocks in a checkpoint over all cores, with `columns` and the number of the
    partition (under the name in `partition`) as doubles. A block has `most` rows, or as many as `most_bytes` of vectors hold."""
    kind, names = "float32" if dict(rows.dtypes)[vector] == "array<float>" else "float64", [*columns, *partition]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v")).astype(kind)
            others = [b.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]
            rows_each = max(1, min(most, most_bytes // max(x[0].nbytes, 1)))
            for i in range(0, len(x), rows_each):
                own = slice(i, i + rows_each)
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([x[own].tobytes()]), *[pa.array([o[own].tobytes()]) for o in others]], names=["p", "v", *names])

    narrow = spread(rows.select(numbers(rows, vector).alias("v"), *[c.cast("double").alias(n) for n, c in columns.items()]))
    narrow = narrow.withColumns({n: F.spark_partition_id().cast("double") for n in partition})
    frame = checkpoint(narrow.mapInArrow(run, ", ".join(["p int", "v binary", *[f"{n} binary" for n in names]])))
    first = frame.select("p").first()
    return Blocks(frame, names, kind, first[0] if first else 0, frame.rdd.getNumPartitions())


def total(blocks: Blocks, part: Part, size: int, fan: int = 32) -> np.ndarray:
    """The sum of part() over all rows. Beyond `fan` partitions their sums meet in levels, each `fan` times fewer."""
    names, kind, p = blocks.names, blocks.kind, blocks.p

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            for v, *others in zip(*(b.column(n) for n in ("v", *names))):
                x = np.frombuffer(v.as_buffer(), kind).reshape(-1, p).astype(np.float64)
                out += part(x, {n: np.frombuffer(o.as_buffer()) for n, o in zip(names, others)})
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["sum"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            for x in b.column("sum"):
                out += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["sum"])

    count = blocks.partitions
    sums = blocks.frame.mapInArrow(add, "sum binary")
    while count > fan:
        count = -(-count // fan)
        sums = sums.repartition(count).mapInArrow(meet, "sum binary")
    return sum((np.frombuffer(r[0]) for r in sums.collect()), np.zeros(size))


@dataclass
class Logistic:
    """Models as columns: score = sigmoid(x @ weights + bias), for vectors as they are. fitted: which could be trained."""

    weights: np.ndarray
    bias: np.ndarray
    fitted: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights + self.bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _moments(x: np.ndarray, y: np.ndarray, k: np.ndarray, count: int) -> np.ndarray:
    """For each part and for all rows: number, positives, and sums of the vectors and of their squares."""
    each = np.column_stack((np.ones(len(x)), y, x, x * x))
    out = np.zeros((count + 1, each.shape[1]))
    order = np.argsort(k, kind="stable")[np.count_nonzero(k < 0) :]
    parts, starts = np.unique(k[order], return_index=True)
    if len(parts):
        out[parts] = np.add.reduceat(each[order], starts)
    out[count] = each.sum(axis=0)
    return out.ravel()


@dataclass
class Problem:
    """`count` models of the rows whose `label` is a number: model k is trained on all of them but those whose `part` is
    `first` + k. Other parts and NaN are in all training sets."""

    label: str
    part: str
    count: int
    first: int = 0

    def of(self, x: np.ndarray, o: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, labels and parts (-1: none of these) of its rows."""
        y, k = o[self.label], np.nan_to_num(o[self.part], nan=-1.0).astype(np.int64) - self.first
        k[(k < 0) | (k >= self.count)] = -1
        own = ~np.isnan(y)
        return (x, y, k) if own.all() else (x[own], y[own], k[own])


def fit_excluding(rows: DataFrame, count: int, vector: str = "v", label: str = "y", part: str = "k", c: float = 1.0, tolerance: float = 1e-7, most_steps: int = 100) -> Logistic:
    """`count` logistic regressions, of which model k is trained on all rows but those whose `part` is k, as fit_together()
    fits them. Rows have a label 0 or 1, a vector of a common length and a part from 0 to count - 1, or -1 for rows that are
    in all training sets."""
    blocks = packed(rows, {"y": F.col(label), "k": F.col(part)}, vector)
    return fit_together(blocks, [Problem("y", "k", count)], c, tolerance, most_steps)[0]


def fit_together(blocks: Blocks, problems: list[Problem], c: float = 1.0, tolerance: float = 1e-7, most_steps: int = 100) -> list[Logistic]:
    """The logistic regressions of each problem; a step of all of them is one pass over the rows.

    Each model standardises by its own means and population deviations and minimises
    the summed loss with a penalty of |w|^2 / 2c, as a model that is fitted alone does; sums of a training
    set are those of all rows less those of its part. A model without both classes is not fitted.

    First one model of all rows of each label takes Newton steps. It is near all others of that label, which then go on from
    it together: an aggregation gives the gradients of all models, and the Hessian of the first one turns them into steps. A
    part's rows only lessen a model's own Hessian, so the steps don't overshoot there; where one would, it is halved.
    The driver holds p numbers for each model of all problems; their number is the caller's to bound.
    """
    p = blocks.p
    if not p:
        return [Logistic(np.zeros((0, q.count)), np.zeros(q.count), np.zeros(q.count, bool)) for q in problems]
    cuts = lambda sizes: np.cumsum(sizes)[:-1]
    sizes = [(q.count + 1) * (2 + 2 * p) for q in problems]
    moments = np.split(total(blocks, lambda x, o: np.concatenate([_moments(*q.of(x, o), q.count) for q in problems]), sum(sizes)), cuts(sizes))
    scales, fitted = [], []
    for q, sums in zip(problems, moments):
        sums = sums.reshape(q.count + 1, -1)
        left = np.vstack((sums[-1] - sums[:-1], sums[-1]))  # the last is the model of all rows
        n = np.maximum(left[:, :1], 1)
        mean = left[:, 2 : 2 + p] / n
        scale = np.sqrt(np.maximum(left[:, 2 + p :] / n - mean * mean, 0))
        scale[scale <= 1e-12 * (1 + np.abs(mean))] = 1.0
        scales.append(scale)
        fitted.append((left[:-1, 1] > 0) & (left[:-1, 1] < left[:-1, 0]))

    def newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        a = np.column_stack((x, np.ones(len(x))))
        q = sigmoid(a @ w)
        return np.concatenate((a.T @ (q - y), ((a * (q * (1 - q))[:, None]).T @ a).ravel()))

    firsts = {q.label: (q, scale[-1]) for q, scale in zip(problems, scales)}
    w, hessian = {name: np.zeros(p + 1) for name in firsts}, {}
    going = [name for name in firsts if any(f.any() for q, f in zip(problems, fitted) if q.label == name)]
    for _ in range(most_steps):
        if not going:
            break
        now = [(firsts[name][0], w[name]) for name in going]
        got = total(blocks, lambda x, o, now=now: np.concatenate([newton(*q.of(x, o)[:2], u) for q, u in now]), len(now) * (p + 1) * (p + 2))
        for name, g in zip(list(going), got.reshape(len(now), -1)):
            # in the vectors' own units: the penalty of a weight is scale^2 w^2 / 2c
            unit = firsts[name][1]
            keep = np.append(unit**2 / c, 0.0)
            hessian[name] = g[p + 1 :].reshape(p + 1, p + 1) + np.diag(keep + 1e-9)
            step = np.linalg.solve(hessian[name], g[: p + 1] + keep * w[name])
            w[name] = w[name] - step
            if np.abs(np.append(unit, 1) * step).max() < 1e-4:
                going.remove(name)

    def gradients(x: np.ndarray, y: np.ndarray, k: np.ndarray, ws: np.ndarray) -> np.ndarray:
        a = np.column_stack((x, np.ones(len(x))))
        r = sigmoid(a @ ws) - y[:, None]
        own = np.flatnonzero(k >= 0)
        r[own, k[own]] = 0.0
        return (a.T @ r).ravel()

    weights = [np.repeat(w[q.label][:, None], q.count, axis=1) for q in problems]
    damps, lasts = [np.ones(q.count) for q in problems], [np.full(q.count, np.inf) for q in problems]
    left = [i for i in range(len(problems)) if fitted[i].any()]
    for _ in range(most_steps):
        if not left:
            break
        now = [(problems[i], weights[i]) for i in left]
        sizes = [(p + 1) * q.count for q, _ in now]
        got = total(blocks, lambda x, o, now=now: np.concatenate([gradients(*q.of(x, o), ws) for q, ws in now]), sum(sizes))
        for i, g in zip(list(left), np.split(got, cuts(sizes))):
            q, scale = problems[i], scales[i][:-1]
            keeps, units = np.vstack(((scale**2 / c).T, np.zeros(q.count))), np.vstack((scale.T, np.ones(q.count)))
            g = g.reshape(p + 1, q.count) + keeps * weights[i]
            turned = np.linalg.solve(hessian[q.label], g)
            size = np.sqrt(np.einsum("ik,ik->k", g, turned))
            damps[i] = np.where(size > 1.01 * lasts[i], damps[i] / 2, damps[i])
            step = turned * damps[i] * fitted[i]
            weights[i], lasts[i] = weights[i] - step, size
            if np.abs(units * step).max() < tolerance:
                left.remove(i)
    return [Logistic(ws[:p], ws[p], f) for ws, f in zip(weights, fitted)]


def fit(rows: DataFrame, vector: str = "v", label: str = "y", c: float = 1.0, tolerance: float = 1e-8, most_steps: int = 100) -> tuple[Logistic, list[float]]:
    """One logistic regression of all rows (label 0 or 1), as fit_excluding() fits them, and its mean loss, without the
    penalty, before each Newton step. A class that is missing leaves the model unfitted."""
    blocks = packed(rows, {"y": F.col(label)}, vector)
    p = blocks.p
    if not p:
        return Logistic(np.zeros((0, 1)), np.zeros(1), np.zeros(1, bool)), []
    none = lambda x: np.full(len(x), -1)
    n, positives, *rest = total(blocks, lambda x, o: _moments(x, o["y"], none(x), 0), 2 + 2 * p)
    mean = np.array(rest[:p]) / n
    scale = np.sqrt(np.maximum(np.array(rest[p:]) / n - mean * mean, 0))
    scale[scale <= 1e-12 * (1 + np.abs(mean))] = 1.0

    def newton(x: np.ndarray, o: dict[str, np.ndarray], w: np.ndarray) -> np.ndarray:
        a = np.column_stack((x, np.ones(len(x))))
        z = a @ w
        q = sigmoid(z)
        return np.concatenate(([(np.logaddexp(0, z) - o["y"] * z).sum()], a.T @ (q - o["y"]), ((a * (q * (1 - q))[:, None]).T @ a).ravel()))

    keep, w, losses = np.append(scale**2 / c, 0.0), np.zeros(p + 1), []
    for _ in range(most_steps):
        got = total(blocks, lambda x, o, w=w: newton(x, o, w), 1 + (p + 1) * (p + 2))
        losses.append(float(got[0] / n))
        step = np.linalg.solve(got[p + 2 :].reshape(p + 1, p + 1) + np.diag(keep + 1e-9), got[1 : p + 2] + keep * w)
        w = w - step
        if np.abs(np.append(scale, 1) * step).max() < tolerance:
            break
    return Logistic(w[:p, None], w[p:], np.array([0 < positives < n])), losses


@dataclass
class Head:
    """Linear, ReLU and linear layer on standardised vectors; logits for label 1."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate((self.w1.ravel(), self.b1, self.w2, self.b2))

    def of(self, flat: np.ndarray) -> Head:
        p, h = self.w1.shape
        return Head(flat[: p * h].reshape(p, h), flat[p * h : p * h + h], flat[p * h + h : p * h + 2 * h], flat[-1:], self.mean, self.scale)

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.scale
        return z, np.maximum(z @ self.w1 + self.b1, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.w2 + self.b2[0]

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Summed cross entropy."""
        z = self.logits(x)
        return float((np.logaddexp(0, z) - y * z).sum())

    def gradient(self, x: np.ndarray, y: np.ndarray, dropped: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Summed loss and its gradient. dropped: factor of each hidden value, 0 or 1 / (1 - dropout)."""
        z, a = self.hidden(x)
        used = a if dropped is None else a * dropped
        out = used @ self.w2 + self.b2[0]
        r = sigmoid(out) - y
        back = r[:, None] * self.w2
        back = (back if dropped is None else back * dropped) * (a > 0)
        return float((np.logaddexp(0, out) - y * out).sum()), np.concatenate(((z.T @ back).ravel(), back.sum(axis=0), used.T @ r, [r.sum()]))


def new_head(p: int, hidden: int, seed: int) -> Head:
    """Start weights, uniform within one over the root of each layer's inputs."""
    rng = np.random.default_rng(seed)
    layer = lambda fan, *shape: rng.uniform(-1, 1, shape) / np.sqrt(fan)
    return Head(layer(p, p, hidden), layer(p, hidden), layer(hidden, hidden), layer(hidden, 1), np.zeros(p), np.ones(p))


def train_head(rows: DataFrame | Blocks, vector: str = "v", label: str = "y", held: str = "held", hidden: int = 256, epochs: int = 120, rate: float = 1e-3, decay: float = 1e-4, dropout: float = 0.3, patience: int | None = None, seed: int = 42) -> tuple[list[Head], list[float], list[float]]:
    """The head after each epoch, and the mean loss of each epoch in training (with dropout) and, after its step, in
    validation (NaN without rows).

    `rows` have a label, a vector and whether they are held for validation, or are blocks of these; each epoch is a pass over
    the blocks. An epoch is one Adam step on the gradient of all training rows, `decay`
    times the weights added. Means and population deviations are those of training rows. Dropout is drawn by seed, epoch,
    partition and row. With `patience` training ends when the validation loss has not fallen for so many epochs.
    The loss in validation comes from the pass of the next epoch, so that an epoch is one job.
    """
    blocks = rows if isinstance(rows, Blocks) else packed(rows, {"y": F.col(label), "held": F.col(held)}, vector, ("at",))
    p = blocks.p
    if not p:
        return [], [], []

    def moments(x: np.ndarray, o: dict[str, np.ndarray]) -> np.ndarray:
        own = x[o["held"] == 0]
        return np.concatenate(([len(own), len(x) - len(own)], own.sum(axis=0), (own * own).sum(axis=0)))

    sums = total(blocks, moments, 2 + 2 * p)
    n, m = sums[:2]
    head = new_head(p, hidden, seed)
    head.mean = sums[2 : 2 + p] / max(n, 1)
    head.scale = np.sqrt(np.maximum(sums[2 + p :] / max(n, 1) - head.mean**2, 0))
    head.scale[head.scale <= 1e-12 * (1 + np.abs(head.mean))] = 1.0
    size = len(head.flat())

    def step(epoch: int, head: Head) -> Part:
        def run(x: np.ndarray, o: dict[str, np.ndarray]) -> np.ndarray:
            train = o["held"] == 0
            own, y, xv, yv = x[train], o["y"][train], x[~train], o["y"][~train]
            out = np.zeros(2 + size)
            if dropout and len(own):
                seen = int(np.abs(own[0]).sum() * 1e6) % (1 << 31)  # blocks of a partition differ
                rng = np.random.default_rng((seed, epoch, int(o["at"][0]), seen))
            for i in range(0, len(own), 512):  # what stays in a core's cache
                some = own[i : i + 512]
                loss, g = head.gradient(some, y[i : i + 512], (rng.random((len(some), hidden)) >= dropout) / (1 - dropout) if dropout else None)
                out[0] += loss
                out[2:] += g
            out[1] = sum(head.loss(xv[i : i + 512], yv[i : i + 512]) for i in range(0, len(xv), 512))
            return out

        return run

    heads, losses, held_losses = [], [], []
    w, one, two = head.flat(), np.zeros(size), np.zeros(size)
    best, since = np.inf, 0
    for epoch in range(1, epochs + 2):
        now = head.of(w)
        got = total(blocks, step(epoch, now), 2 + size)
        if epoch > 1:
            held_losses.append(float(got[1] / m) if m else float("nan"))
            since = 0 if held_losses[-1] < best else since + 1
            best = min(best, held_losses[-1])
        if epoch > epochs or (patience is not None and since >= patience):
            break
        losses.append(float(got[0] / max(n, 1)))
        g = got[2:] / max(n, 1) + decay * w
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        w = w - rate * (one / (1 - 0.9**epoch)) / (np.sqrt(two / (1 - 0.999**epoch)) + 1e-8)
        heads.append(head.of(w))
    return heads, losses, held_losses


def head_scores(rows: DataFrame, heads: list[Head], vector: str, keep: list[str], epoch: str = "epoca", score: str = "score") -> DataFrame:
    """A row of `keep`, epoch (from 1) and probability for each of `rows` and each head, in one narrow pass."""
    out = rows.select(*keep, F.col(vector).alias("v"))
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep)
    shared = rows.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                own = b.slice(i, 4096)
                x = matrix(own.column("v"))
                for k, head in enumerate(shared.value):
                    yield pa.RecordBatch.from_arrays([*[own.column(c) for c in keep], pa.array(np.full(len(x), k + 1, np.int32)), pa.array(sigmoid(head.logits(x)))], names=[*keep, epoch, score])

    return out.mapInArrow(run, f"{kinds}, {epoch} int, {score} double")

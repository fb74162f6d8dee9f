"""The evaluation protocols with a trained model, and the events of a training run.

All folds or held-out keys are trained together: each step of all models is one pass over the rows (see learning.py),
so neither jobs nor plans grow with their number. The state of a data set trains the models of all its protocols in the
same passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..storage import checkpoint
from . import auc as A
from . import evaluation as ev
from . import learning


@dataclass
class _Test:
    """The models of a problem, and the column `ks` of the models that score a row."""

    problem: learning.Problem
    ks: str
    models: learning.Logistic | None = None


def _scores(rows: DataFrame, tests: list[_Test]) -> DataFrame:
    """test (its place in `tests`), k, y and score of each of `rows` (v, labels and ks) by each fitted model of its ks."""
    shared = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                own = b.slice(i, 2048)
                x = learning.matrix(own.column("v"))
                for place, t in enumerate(shared.value):
                    ks = own.column(t.ks)
                    sizes = np.asarray(ks.value_lengths().fill_null(0))
                    at, k = np.repeat(np.arange(len(x)), sizes), ks.flatten().to_numpy(zero_copy_only=False)
                    here = (k >= t.problem.first) & (k < t.problem.first + t.problem.count)
                    at, k = at[here], k[here].astype(np.int64)
                    good = t.models.fitted[k - t.problem.first]
                    at, k = at[good], k[good]
                    score = t.models.scores(x)[at, k - t.problem.first]
                    y = own.column(t.problem.label).to_numpy(zero_copy_only=False)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), place, np.int32)), pa.array(k.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(score)], names=["test", "k", "y", "score"])

    labels = dict.fromkeys(t.problem.label for t in tests)
    return rows.select("v", *[F.col(c).cast("int").alias(c) for c in labels], *dict.fromkeys(t.ks for t in tests)).mapInArrow(run, "test int, k int, y int, score double")


def grouped_cv(rows: DataFrame, vector: str, group: str, label: str = "y", folds: int = 5) -> DataFrame:
    """fold, n_pos, n_neg and auc of a model for each fold, trained on the others; no group is on
    both sides. Folds without both classes in training or test have no row."""
    folded = ev.stratified_group_kfold(rows.where(F.col(label).isin(0, 1)), group, label, folds)
    folded = checkpoint(folded.select(F.col("fold").alias("k"), F.col(label).alias("y"), learning.numbers(folded, vector).alias("v")))
    models = learning.fit_excluding(folded, folds)
    tested = _scores(folded.select(F.array("k").alias("ks"), "y", "v"), [_Test(learning.Problem("y", "k", folds), "ks", models)])
    return A.auc(tested.select(F.col("k").alias("fold"), F.col("y").alias(label), "score"), ("fold",), label)


def held_out(rows: DataFrame, vector: str, key: str, same_source: bool = True, source: str = "fonte", label: str = "y", least_keys: int = 1, most_models: int = 2048) -> DataFrame:
    """key, n_pos, n_neg and auc with each key of the positives held out in turn.

    Trained on all but the held-out positives; tested on these and on the negatives of their
    sources, or all negatives. Empty and null keys are not held out; a key without negatives to
    compare with, or without other positives to learn from, has no row, and with fewer than
    `least_keys` keys there is none at all. Up to `most_models` keys are trained together; more
    come in as many blocks.
    """
    named = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    narrow = checkpoint(rows.where(F.col(label).isin(0, 1)).select(F.when(named & (F.col(label) == 1), F.col(key)).alias("key"), F.col(source).alias("source"), F.col(label).alias("y"), learning.numbers(rows, vector).alias("v")))
    kind = dict(narrow.dtypes)["key"]
    keys = [r[0] for r in narrow.where("key is not null").select("key").distinct().orderBy("key").toLocalIterator()]
    parts = []
    for i in range(0, len(keys) if len(keys) >= least_keys else 0, most_models):
        own = keys[i : i + most_models]
        # a row for each of at most `most_models` keys
        numbers = F.broadcast(narrow.sparkSession.createDataFrame([(x, k) for k, x in enumerate(own)], f"key {kind}, k int"))
        parted = checkpoint(narrow.join(numbers, "key", "left").select("source", "y", "v", F.coalesce("k", F.lit(-1)).alias("k")))
        models = learning.fit_excluding(parted, len(own))
        positives = parted.where("k >= 0").select(F.array("k").alias("ks"), "y", "v")
        negatives = parted.where("y = 0")
        if same_source:
            of = parted.where("k >= 0").groupBy("source").agg(F.collect_set("k").alias("ks"))
            negatives = negatives.join(of, "source").select("ks", "y", "v")
        else:
            negatives = negatives.select(F.sequence(F.lit(0), F.lit(len(own) - 1)).alias("ks"), "y", "v")
        tested = _scores(positives.unionAll(negatives), [_Test(learning.Problem("y", "k", len(own)), "ks", models)])
        parts.append(A.auc(tested, ("k",)).join(numbers, "k").select(F.col("key").alias(key), "n_pos", "n_neg", "auc"))
    if not parts:
        return narrow.sparkSession.createDataFrame([], f"{key} {kind}, n_pos long, n_neg long, auc double")
    return reduce(DataFrame.unionAll, parts)


def separability(rows: DataFrame, vector: str, group: str, source: str = "fonte", folds: int = 5) -> float | None:
    """Mean grouped AUC of the first source (in order) against the others; null with one source."""
    least, n = rows.agg(F.min(source), F.countDistinct(source)).first()
    if n < 2:
        return None
    named = rows.withColumn("_first", (F.col(source) == F.lit(least)).cast("int"))
    return grouped_cv(named, vector, group, "_first", folds).agg(F.avg("auc")).first()[0]


@dataclass
class _Prepared:
    """Rows in a checkpoint, with numbers for what is held out: _y, _first (whether its source is the first), _fold and
    _first_fold of these two, and _technique and _generator of positives; and the keys with these numbers."""

    rows: DataFrame
    keys: dict[str, list]
    sources: int


def _prepared(rows: DataFrame, vector: str, group: str, source: str, technique: str, generator: str | None, label: str, folds: int) -> _Prepared:
    named = {"_technique": technique} | ({"_generator": generator} if generator else {})
    even = checkpoint(rows.select(*dict.fromkeys([label, source, group, *named.values()]), learning.numbers(rows, vector).alias("v")))
    valid, y = F.col(label).isin(0, 1), F.when(F.col(label).isin(0, 1), F.col(label)).cast("int")
    least, sources = even.agg(F.min(source), F.countDistinct(source)).first()
    out = even.withColumns({"_y": y, "_first": (F.col(source) == F.lit(least)).cast("int") if sources > 1 else F.lit(None).cast("int")})
    for name, chosen, of in (("_fold", even.where(valid), label), ("_first_fold", out.where(F.col("_first").isNotNull()), "_first")):
        dealt = ev.stratified_groups(chosen, group, of, folds).withColumnsRenamed({"_group": f"{name}_group", "fold": name})
        out = out.join(dealt, F.col(group).eqNullSafe(F.col(f"{name}_group")), "left").drop(f"{name}_group")
    keys = {}
    for name, c in named.items():
        kind = dict(even.dtypes)[c]
        held = even.where((F.col(label) == 1) & F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
        keys[name] = [r[0] for r in held.select(c).distinct().orderBy(c).toLocalIterator()]
        numbers = rows.sparkSession.createDataFrame([(x, k) for k, x in enumerate(keys[name])], f"_key {kind}, _k int")
        numbers = F.broadcast(numbers) if len(keys[name]) <= 20_000 else numbers
        out = out.join(numbers, F.col(c) == F.col("_key"), "left").withColumn(name, F.when(F.col("_y") == 1, F.col("_k"))).drop("_key", "_k")
    return _Prepared(checkpoint(out), keys, sources)


def _blocks(even: _Prepared) -> learning.Blocks:
    """The prepared rows for training; the first of the folds is held for validation."""
    numbers = {"_y": F.col("_y"), "_first": F.col("_first"), "_fold": F.col("_fold"), "_first_fold": F.col("_first_fold"), **{c: F.col(c) for c in even.keys}}
    head = {"y": F.col("_y"), "held": (F.col("_fold") == 0).cast("int")}
    return learning.packed(even.rows, numbers | head, partition=("at",))


def _areas(even: _Prepared, blocks: learning.Blocks, source: str, folds: int, most_models: int = 2048) -> dict[str, dict[int, float]]:
    """For the folds of _fold and _first_fold and the keys of each held-out column, their areas by number, as grouped_cv() and
    held_out() have them. Up to `most_models` models are trained together; more come in as many rounds."""
    wanted = [("_fold", "_y", folds), ("_first_fold", "_first", folds if even.sources > 1 else 0), *[(c, "_y", len(x)) for c, x in even.keys.items()]]
    rounds, room = [], 0
    for part, label, count in wanted:
        for first in range(0, count, most_models):
            own = min(count - first, most_models)
            if own > room:
                rounds.append([])
                room = most_models
            rounds[-1].append(_Test(learning.Problem(label, part, own, first), f"{part}_ks"))
            room -= own
    of = even.rows.where("_y = 1").groupBy(F.col(source).alias("_source")).agg(*[F.collect_set(c).alias(f"_of{c}") for c in even.keys])
    ks = {c: F.when(F.col("_y") == 1, F.when(F.col(c).isNotNull(), F.array(c))).when(F.col("_y") == 0, F.col(f"_of{c}")) for c in even.keys}
    ks |= {c: F.when(F.col(label).isNotNull() & F.col(c).isNotNull(), F.array(c)) for c, label in (("_fold", "_y"), ("_first_fold", "_first"))}
    # a row for each source; few as a rule, and then rows stay where they are
    of = F.broadcast(of) if even.sources * sum(map(len, even.keys.values())) <= 100_000 else of
    scored = learning.spread(even.rows).join(of, F.col(source) == F.col("_source"), "left").withColumns({f"{c}_ks": x for c, x in ks.items()})
    out = {part: {} for part, _, _ in wanted}
    for tests in rounds:
        for t, models in zip(tests, learning.fit_together(blocks, [t.problem for t in tests])):
            t.models = models
        for r in A.auc(checkpoint(_scores(scored, tests)), ("test", "k")).select("test", "k", "auc").toLocalIterator():
            out[tests[r["test"]].problem.part][r["k"]] = r["auc"]
    return out


def generator_state(rows: DataFrame, vector: str, key: str, group: str, source: str = "fonte", technique: str = "tecnica", generator: str | None = "gerador", label: str = "y", balance: bool = True, folds: int = 5) -> DataFrame:
    """One row, the event estado_gerador: counts and maps of counts after balancing, the source-only
    AUC before it, grouped and held-out AUC of the model, and how far the sources can be told
    apart. Without a generator column logo is null and por_gerador empty."""
    even = _prepared(ev.balance_by_source(rows, key, source, label) if balance else rows, vector, group, source, technique, generator, label, folds)
    return _state(rows, even, _blocks(even), source, technique, generator, label, balance, folds)


def _state(rows: DataFrame, prepared: _Prepared, blocks: learning.Blocks, source: str, technique: str, generator: str | None, label: str, balance: bool, folds: int) -> DataFrame:
    areas, even = _areas(prepared, blocks, source, folds), prepared.rows
    positives = even.where(F.col(label) == 1)
    as_map = lambda c: {str(prepared.keys[c][k]): a for k, a in areas[c].items()}
    mean = lambda c: float(np.mean(list(areas[c].values()))) if areas[c] else None
    loto, logo = as_map("_technique"), as_map("_generator") if generator else None
    many = lambda m, kind: F.lit(None).cast(f"map<string,{kind}>") if m is None else F.create_map(*[F.lit(x) for pair in sorted(m.items()) for x in pair]).cast(f"map<string,{kind}>")
    counts = even.agg(F.count(F.lit(1)).cast("int").alias("n_amostras"), F.count_if(F.col(label) == 1).cast("int").alias("n_fraude"), F.count_if(F.col(label) == 0).cast("int").alias("n_legitimo"))
    maps = [ev.counts_as_map(positives, technique, "por_tecnica"), ev.counts_as_map(positives, generator, "por_gerador") if generator else None, ev.counts_as_map(even, source, "por_fonte")]
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [m for m in maps if m is not None], counts)
    if not generator:
        out = out.withColumn("por_gerador", F.create_map().cast("map<string,bigint>"))
    values = {
        "tipo": F.lit("estado_gerador"),
        "auc_fonte_sozinha": F.lit(ev.auc_source_only(rows, source, label).first()["auc"]).cast("double"),
        "equilibrado_por_origem": F.lit(balance),
        "auc_agrupada": F.lit(mean("_fold")).cast("double"),
        "loto": many(loto, "double"),
        "logo": many(logo, "double"),
        "separabilidade_fonte": F.lit(mean("_first_fold")).cast("double"),
    }
    return out.withColumns(values)


def training_events(rows: DataFrame, vector: str, key: str, group: str, run_id: str, source: str = "fonte", technique: str = "tecnica", generator: str | None = "gerador", label: str = "y", epochs: int = 120, patience: int | None = None, **head) -> DataFrame:
    """The events of one training run of the network head (schemas.EVENT), in their order: inicio, estado_gerador, an
    epoca for each epoch, and fim.

    Rows are balanced by source and a fifth of their groups is held for validation. Each epoch has its mean loss in
    training and validation, and the AUC in validation, of all rows and of each technique against the negatives of its
    sources. Scores of all epochs come from one pass over the validation rows, and their areas from
    one aggregation each. Without both classes in validation auc_val is null.
    """
    spark = rows.sparkSession
    even = _prepared(ev.balance_by_source(rows, key, source, label), vector, group, source, technique, generator, label, 5)
    blocks = _blocks(even)
    heads, losses, held_losses = learning.train_head(blocks, epochs=epochs, patience=patience, **head)
    held = (F.col("_fold") == 0).cast("int").alias("held")
    counts = {r[0]: r[1] for r in even.rows.groupBy(held).count().collect()}
    n = len(heads)
    columns = learning.spread(even.rows).where("_fold = 0").select(F.col("_y").alias("y"), "v", F.col(source).cast("string").alias("source"), F.col(technique).cast("string").alias("technique"))
    tested = checkpoint(learning.head_scores(columns, heads, "v", ["y", "source", "technique"]))
    whole = A.auc(tested, ("epoca",)).select("epoca", F.col("auc").alias("auc_val"))
    # a technique's negatives are those of its sources in the same epoch
    own = lambda c: F.when(F.col(c) != "", F.concat_ws(":", "epoca", c))
    each = A.auc_of_held_out(tested.withColumns({"key": own("technique"), "fonte": F.concat_ws(":", "epoca", F.coalesce("source", F.lit("")))}), "key")
    cut = F.split("key", ":", 2)
    maps = each.groupBy(cut[0].cast("int").alias("epoca")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(cut[1].alias("k"), "auc")))).alias("auc_por_tecnica"))
    curve = spark.createDataFrame([(k + 1, losses[k], held_losses[k]) for k in range(n)], "epoca int, loss_treino double, loss_val double")
    curve = curve.join(whole, "epoca", "left").join(maps, "epoca", "left")
    kinds = F.when(F.col("id") == 0, "inicio").when(F.col("id") == 1, "estado_gerador").when(F.col("id") == n + 2, "fim").otherwise("epoca")
    base = spark.range(n + 3).select(F.col("id"), F.lit(run_id).alias("run_id"), (F.unix_millis(F.current_timestamp()) / 1000.0 + F.col("id") / 1e6).alias("ts"), kinds.alias("tipo"))
    first = F.col("tipo") == "inicio"
    series = {
        "epoca": F.when(F.col("tipo") == "epoca", F.col("id") - 1).cast("int"),
        "epocas": F.when(F.col("tipo").isin("inicio", "fim"), n),
        "dispositivo": F.when(first, "spark"),
        "n_treino": F.when(first, counts.get(0, 0)).cast("int"),
        "n_val": F.when(first, counts.get(1, 0)).cast("int"),
    }
    state = _state(rows, even, blocks, source, technique, generator, label, True, 5)
    own_columns = [c for c in state.columns if c != "tipo"]
    out = base.withColumns(series).join(curve, "epoca", "left").join(state.select("tipo", *own_columns), "tipo", "left").orderBy("id")
    names = [c.split()[0] for c in schemas.EVENT.split(", ")]
    types = dict(c.split(" ", 1) for c in schemas.EVENT.split(", "))
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(types[c]).alias(c) for c in names])

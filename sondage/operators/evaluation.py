"""Evaluation protocols against leakage: balancing, grouped folds, held-out groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import fold_of, hash_rank
from ..storage import checkpoint
from . import auc as A
from . import learning


def auc_source_only(rows: DataFrame, source: str = "fonte", label: str = "y") -> DataFrame:
    """One row: the AUC of each row's source's positive rate as its score. Null with fewer than
    two sources or classes; 0.5 means that the source tells nothing."""
    rates = rows.where(F.col(label).isNotNull()).groupBy(source).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("c"))
    hist = rates.groupBy((F.col("p") / F.col("c")).alias("score")).agg(F.sum("p").alias("p"), F.sum(F.col("c") - F.col("p")).alias("n"))
    sources = rates.agg(F.count(F.lit(1)).alias("n_sources"))
    found = A.from_histogram(hist).select("auc")
    return sources.join(found, how="left").select("n_sources", F.when(F.col("n_sources") >= 2, F.col("auc")).alias("auc"))


def balance_by_source(rows: DataFrame, key: str, source: str = "fonte", label: str = "y") -> DataFrame:
    """As many rows of each class within each source: the larger class is cut to the size of
    the smaller by the hash order of `key`. Sources without one of the classes go; if
    that leaves nothing, all rows stay."""
    counts = rows.groupBy(source).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    least = counts.select(F.col(source).alias("_source"), F.least("_p", "_n").alias("_least"))
    any_left = least.agg(F.coalesce(F.max("_least"), F.lit(0)).alias("_any"))
    ranked = hash_rank(rows.where(F.col(label).isin(0, 1)), [source, label], key, "_rank")
    kept = ranked.join(least, ranked[source].eqNullSafe(least["_source"])).crossJoin(F.broadcast(any_left))
    return kept.where((F.col("_any") == 0) | (F.col("_rank") <= F.col("_least"))).select(*rows.columns)


def group_kfold(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """`rows` with `fold`; all rows of a group are in one fold."""
    return rows.withColumn("fold", fold_of(F.col(group), folds))


def dealt_folds(sizes: list[tuple[int, int, int]], folds: int) -> list[tuple[int, int, int, int]]:
    """n, p, place and fold of the groups that even dealing leaves over.

    `sizes` has n rows, p positives and how many groups are like that. Of like groups every fold gets the same number
    first, which leaves the folds' differences as they are; the others, largest first, go one by one to
    the fold in which they add least to the spread of the class counts over folds, each class as a share of all its
    rows; the first such fold on a tie. Whole numbers decide, so that nothing is rounded.
    """
    all_p = sum(p * m for _, p, m in sizes) or 1
    all_n = sum((n - p) * m for n, p, m in sizes) or 1
    pos, neg, out = [0] * folds, [0] * folds, []
    for n, p, m in sorted(sizes, key=lambda x: (-x[0], -x[1])):
        for place in range(1, m % folds + 1):
            f = min(range(folds), key=lambda k: (p * (2 * pos[k] + p) * all_n**2 + (n - p) * (2 * neg[k] + n - p) * all_p**2, k))
            pos[f] += p
            neg[f] += n - p
            out.append((n, p, place, f))
    return out


def stratified_group_kfold(rows: DataFrame, group: str, label: str = "y", folds: int = 5) -> DataFrame:
    """`rows` with `fold`; all rows of a group are in one fold, and folds have as nearly as greedy dealing gets the same
    rows of each class. The greedy choice runs over the histogram of (rows, positives) of
    groups (see dealt_folds), which comes to the driver, and groups that are alike are dealt in hash order: its cost
    doesn't grow with the number of groups."""
    dealt = stratified_groups(rows, group, label, folds)
    return rows.join(dealt, rows[group].eqNullSafe(dealt["_group"])).select(*rows.columns, "fold")


def stratified_groups(rows: DataFrame, group: str, label: str = "y", folds: int = 5) -> DataFrame:
    """_group and fold: a row for each group, as stratified_group_kfold() deals them."""
    per = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(label) == 1).alias("_pos"))
    sizes = [tuple(r) for r in per.groupBy("_rows", "_pos").agg(F.count(F.lit(1)).alias("m")).toLocalIterator()]
    chosen = dealt_folds(sizes, folds)
    left = rows.sparkSession.createDataFrame(chosen, "_rows long, _pos long, _place long, _fold int")
    left = F.broadcast(left) if len(chosen) <= 20_000 else left
    ranked = hash_rank(per, ["_rows", "_pos"], "_group", "_at")
    same = (ranked["_rows"] == left["_rows"]) & (ranked["_pos"] == left["_pos"]) & (ranked["_at"] == left["_place"])
    # places up to m % folds of m like groups go where the greedy choice puts them, all others in turn
    return ranked.join(left, same, "left").select("_group", F.coalesce("_fold", F.pmod(F.col("_at"), F.lit(folds)).cast("int")).alias("fold"))


def leak_check(folded: DataFrame, group: str) -> DataFrame:
    """One row: number of groups, and of those found in more than one fold."""
    per = folded.groupBy(group).agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("a") != F.col("b")).alias("n_leaks"))


def fold_summary(folded: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """One row: number of folds with both classes, mean and population deviation of their AUC."""
    per = A.auc(folded, ("fold",), label, score)
    return per.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroid_scores(folded: DataFrame, vector: str, label: str = "y") -> DataFrame:
    """`folded` with the score that a nearest-centroid model gives each row which was trained on
    the other folds: the projection on the line between the class centroids.

    Centroids come from one aggregation by fold, class and position, so vectors are
    combined before the shuffle; the table of directions has one row for each fold.
    """
    cells = folded.where(F.col(label).isin(0, 1)).select("fold", F.col(label).alias("_y"), F.posexplode(F.col(vector).cast("array<double>")).alias("_i", "_x"))
    sums = cells.groupBy("fold", "_y", "_i").agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).alias("_c"))
    folds = sums.select(F.col("fold").alias("_held")).distinct()
    train = folds.join(sums, F.col("_held") != F.col("fold")).groupBy("_held", "_i").agg(*[(F.sum(F.when(F.col("_y") == c, F.col("_s"))) / F.sum(F.when(F.col("_y") == c, F.col("_c")))).alias(f"_m{c}") for c in (0, 1)])
    lines = train.groupBy("_held").agg(F.array_sort(F.collect_list(F.struct("_i", (F.col("_m1") - F.col("_m0")).alias("_d")))).alias("_line"))
    lines = lines.select("_held", F.transform("_line", lambda x: x["_d"]).alias("_line"))
    return folded.join(F.broadcast(lines), folded["fold"] == lines["_held"]).select(*folded.columns, dot(F.col(vector), F.col("_line")).alias("score"))


def held_out_masks(rows: DataFrame, key: str, source: str = "fonte", label: str = "y") -> DataFrame:
    """For each held-out key: sizes of its training set (all but its positives) and of its test
    set (its positives and the negatives of their sources)."""
    named = F.col(key).isNotNull() & (F.col(key) != "")
    total = rows.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col(label) == 1).alias("pos_all"))
    positives = rows.where((F.col(label) == 1) & named)
    own = positives.groupBy(key).agg(F.count(F.lit(1)).alias("n_test_pos"))
    negatives = rows.where(F.col(label) == 0).groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    against = positives.select(key, source).distinct().join(negatives, source).groupBy(key).agg(F.sum("n").alias("n_test_neg"))
    out = own.join(against, key, "left").crossJoin(F.broadcast(total))
    return out.select(key, (F.col("n_all") - F.col("n_test_pos")).alias("n_train"), (F.col("pos_all") - F.col("n_test_pos")).alias("n_train_pos"), "n_test_pos", F.coalesce("n_test_neg", F.lit(0)).cast("long").alias("n_test_neg"))


def held_out_sources(rows: DataFrame, key: str, source: str = "fonte", label: str = "y") -> DataFrame:
    """Sources of each key's positives and how many negatives each has."""
    named = F.col(key).isNotNull() & (F.col(key) != "")
    mine = rows.where((F.col(label) == 1) & named).select(key, source).distinct()
    negatives = rows.where(F.col(label) == 0).groupBy(source).agg(F.count(F.lit(1)).alias("n_neg"))
    return mine.join(negatives, source)


def held_out_auc(rows: DataFrame, key: str, same_source: bool = True, source: str = "fonte", label: str = "y", score: str = "score", count: str | None = None) -> DataFrame:
    """key, n_pos, n_neg, auc with each key held out in turn. `count` names a column that says
    how many samples a row stands for.

    The model is the linear score whose sign is learned from the training set: the score itself
    if training positives score higher on average than negatives, else its negative.
    Each training mean is the total less the held-out key's part.
    """
    valid = rows.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    many = F.col(count) if count else F.lit(1)
    named = F.col(key).isNotNull() & (F.col(key) != "")
    total = valid.agg(*[F.sum(F.when(F.col(label) == c, x)).alias(f"_{a}{c}") for c in (0, 1) for a, x in (("s", many * F.col(score)), ("c", many))])
    own = valid.where((F.col(label) == 1) & named).groupBy(key).agg(F.sum(many * F.col(score)).alias("_s"), F.sum(many).alias("_c"))
    rise = (F.col("_s1") - F.col("_s")) / F.nullif(F.col("_c1") - F.col("_c"), F.lit(0)) - F.col("_s0") / F.nullif(F.col("_c0"), F.lit(0))
    signs = own.crossJoin(F.broadcast(total)).select(F.col(key).alias("_key"), F.when(rise < 0, -1.0).otherwise(1.0).alias("_sign"))
    plain = A.auc_of_held_out(valid, key, same_source, source, label, score, count)
    # where the sign is negative all of a key's scores change sign, so an area a becomes 1 - a
    return plain.join(signs, plain[key] == signs["_key"]).select(key, "n_pos", "n_neg", F.when(F.col("_sign") < 0, 1 - F.col("auc")).otherwise(F.col("auc")).alias("auc"))


def snapshot(rows: DataFrame, key: str, group: str, source: str = "fonte", label: str = "y", score: str = "score", technique: str = "tecnica", generator: str = "gerador", folds: int = 5) -> DataFrame:
    """One row on the state of a data set: counts and maps of counts after balancing, the source-only
    AUC before it, the mean grouped AUC, and the AUC of each technique and generator held out (maps
    loto and logo, with loto's lowest and highest) after it."""
    # the samples are read once; all else needs these columns alone
    narrow = checkpoint(rows.select(key, group, source, technique, generator, label, score))
    even = group_kfold(balance_by_source(narrow, key, source, label), group, folds)
    # all that follows needs no more than how often each combination occurs
    cells = checkpoint(even.groupBy("fold", source, technique, generator, label, score).agg(F.count(F.lit(1)).alias("_c")))
    y, many = F.col(label), lambda test: F.coalesce(F.sum(F.when(test, F.col("_c"))), F.lit(0))
    counts = cells.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_amostras"), many(y == 1).alias("n_fraude"), many(y == 0).alias("n_legitimo"), F.countDistinct(source).alias("n_fontes"))
    by_fold = cells.groupBy("fold", F.col(score).alias("score")).agg(many(y == 1).alias("p"), many(y == 0).alias("n"))
    as_map = lambda name: F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "auc")))).alias
    small = [held_out_auc(cells.groupBy(source, k, label, score).agg(F.sum("_c").alias("_c")), k, True, source, label, score, "_c") for k in (technique, generator)]
    parts = [
        counts_as_map(cells.where(y == 1), technique, "por_tecnica", "_c"),
        counts_as_map(cells.where(y == 1), generator, "por_gerador", "_c"),
        counts_as_map(cells, source, "por_fonte", "_c"),
        auc_source_only(narrow, source, label).select(F.col("auc").alias("auc_fonte_sozinha")),
        A.from_histogram(by_fold, ("fold",)).agg(F.avg("auc").alias("auc_agrupada")),
        small[0].agg(F.min("auc").alias("loto_min"), F.max("auc").alias("loto_max"), as_map(technique)("loto")),
        small[1].agg(as_map(generator)("logo")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, counts)


def counts_as_map(rows: DataFrame, name: str, out: str, count: str | None = None) -> DataFrame:
    """One row: map of value -> number of rows, empty and null values under an empty key. `count`
    names a column that says how many rows a row stands for."""
    counts = rows.groupBy(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("k")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("v"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(out))


def fit_logistic(rows: DataFrame, vector: str, label: str = "y", c: float = 1.0) -> tuple[learning.Logistic, list[float]]:
    """A logistic regression on standardised vectors (population deviations) with a summed loss and an L2 penalty
    of 1/c: the fitted model and its mean loss before each step. Rows with another label than 0 or 1 teach nothing."""
    return learning.fit(rows.where(F.col(label).isin(0, 1)), vector, label, c)

"""Exact areas under the ROC curve, from score histograms.

The area is the share of pairs (positive, negative) in which the positive scores higher,
ties counting one half. Rows are first counted by score; then the number of negatives
below each score is summed in two levels: within ranges of scores between quantiles, and
over the ranges. No window holds more than one range of one group, so neither a single
curve over all rows nor one hot group ends in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES, STEP = 64, 8


def histogram(rows: DataFrame, by: tuple[str, ...] = (), label: str = "y", score: str = "score") -> DataFrame:
    """`by`, score, p, n: positives and negatives with each score; rows without label or score don't count."""
    valid = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return valid.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))


def from_histogram(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, n_pos, n_neg and auc. A group with one class has no row."""
    cuts = hist.agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 2000).alias("cuts"))
    # the number of cuts below a score: of every eighth first, then of the eight that follow these
    coarse = F.transform(F.sequence(F.lit(STEP), F.lit(RANGES - STEP), F.lit(STEP)), lambda k: F.get("cuts", k - 1))
    cuts = cuts.withColumn("coarse", coarse)
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col("score")))
    placed = hist.crossJoin(F.broadcast(cuts)).withColumn("step", below(F.col("coarse")))
    placed = placed.withColumn("range", F.col("step") * STEP + below(F.slice("cuts", F.col("step") * STEP + 1, STEP))).drop("cuts", "coarse", "step")
    inside = Window.partitionBy(*by, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranges = placed.groupBy(*by, "range").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("area"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    over = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    total = ranges.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("area") + F.col("p") * F.col("before")).alias("area"))
    kept = total.where("n_pos > 0 and n_neg > 0")
    return kept.select(*by, "n_pos", "n_neg", (F.col("area") / F.col("n_pos") / F.col("n_neg")).alias("auc"))


def auc(rows: DataFrame, by: tuple[str, ...] = (), label: str = "y", score: str = "score") -> DataFrame:
    """`by`, n_pos, n_neg and auc of the rows."""
    return from_histogram(histogram(rows, by, label, score), by)


def auc_of_held_out(rows: DataFrame, key: str, same_source: bool = True, source: str = "fonte", label: str = "y", score: str = "score", count: str | None = None) -> DataFrame:
    """key, n_pos, n_neg and auc of each key's positives against negatives.

    same_source: only negatives from sources in which the key has positives; otherwise all
    negatives. Negatives are counted by source and score before they meet the keys, so
    nothing is multiplied but histogram rows. `count` names a column that says how many
    samples a row stands for.
    """
    many = F.sum(count) if count else F.count(F.lit(1))
    named = F.col(key).isNotNull() & (F.col(key) != "")
    positives = rows.where((F.col(label) == 1) & named)
    negatives = rows.where(F.col(label) == 0)
    pos = positives.groupBy(key, F.col(score).alias("score")).agg(many.alias("p"), F.lit(0).cast("long").alias("n"))
    if same_source:
        where = positives.select(key, source).distinct()
        counted = negatives.groupBy(source, F.col(score).alias("score")).agg(many.alias("n"))
        neg = counted.join(where, source)
    else:
        counted = negatives.groupBy(F.col(score).alias("score")).agg(many.alias("n"))
        neg = counted.crossJoin(positives.select(key).distinct())
    neg = neg.groupBy(key, "score").agg(F.lit(0).cast("long").alias("p"), F.sum("n").alias("n"))
    both = pos.unionByName(neg)
    hist = both.groupBy(key, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return from_histogram(hist, (key,))

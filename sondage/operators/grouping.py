"""Counts, distinct values, shares, last and first rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_rank


def summary(rows: DataFrame, label: str = "y") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 1).alias("fraude"), F.count_if(F.col(label) == 0).alias("legitimo"))


def counts(rows: DataFrame, key: str) -> DataFrame:
    """key and n, most frequent first; null and empty keys are dropped after counting."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).orderBy(F.desc("n"), key)


def distinct_count(rows: DataFrame, key: str) -> DataFrame:
    """One row: number of different values, null being one of them if it occurs."""
    return rows.agg((F.countDistinct(key) + F.max(F.col(key).isNull().cast("long"))).alias("n"))


def distinct_sorted(rows: DataFrame, key: str) -> DataFrame:
    """Different values of a key that are neither null nor empty, in order."""
    return rows.select(key).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).distinct().orderBy(key)


def share_of_max(per: DataFrame, value: str = "n") -> DataFrame:
    """`per` with share: percent of the greatest value. The greatest is one row, looked up beside the rows."""
    return per.crossJoin(F.broadcast(per.agg(F.max(value).alias("_max")))).withColumn("share", 100.0 * F.col(value) / F.col("_max")).drop("_max")


def last_n(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n last rows in `order`; each task keeps n at most before they meet."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def stratified(rows: DataFrame, key: str, ident: str, k: int) -> DataFrame:
    """k rows of each value of `key`, the first in the hash order of `ident`; all if there are fewer."""
    return hash_rank(rows, [key], ident, "_rank").where(F.col("_rank") <= k).drop("_rank")


def most_frequent(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value and n: the most frequent value of each group; the smallest of several."""
    per = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def argmax(rows: DataFrame, by: str, measure: Column, place: list[str], fields: list[str]) -> DataFrame:
    """by and fields of the row of each group with the greatest measure, first in `place` among equals."""
    key = F.struct((-measure).alias("_m"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(place)])
    best = rows.groupBy(by).agg(F.min_by(F.struct(*fields), key).alias("b"))
    return best.select(by, *[F.col("b")[f].alias(f) for f in fields])


def union_groups(groups: dict[str, DataFrame]) -> DataFrame:
    """All rows of several frames of equal columns, with the column `grupo`."""
    parts = [f.withColumn("grupo", F.lit(name)) for name, f in groups.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gated_range(scores: DataFrame, n_rows: str = "n_pos", value: str = "auc", least: int = 20) -> DataFrame:
    """One row: range of the scores that rest on `least` rows or more, how many they are, and
    whether the range is under 0.1. No row with fewer than two such scores."""
    kept = scores.where(F.coalesce(F.col(n_rows), F.lit(0)) >= least)
    return kept.agg(F.count(F.lit(1)).alias("n_keys"), (F.max(value) - F.min(value)).alias("amplitude")).where("n_keys >= 2").withColumn("ok", F.col("amplitude") < 0.1)


def run_state(events: DataFrame, run: str, kind: str, order: list[str], epoch: str) -> DataFrame:
    """run, starts, n_epochs and epochs (in order) of each run: the epochs since its last start.

    An event inicio starts the run anew, epoca appends, others change nothing. The last
    start of a run comes from an aggregation, so runs of any length are never sorted as
    a whole; only what follows the last start is collected into the run's row.
    """
    place = F.struct(*order)
    used = events.where(F.col(kind).isin("inicio", "epoca"))
    per = used.groupBy(run).agg(F.count_if(F.col(kind) == "inicio").alias("starts"), F.max(F.when(F.col(kind) == "inicio", place)).alias("_start"))
    epochs = used.where(F.col(kind) == "epoca").withColumn("_place", place).join(per.select(run, "_start"), run).where(F.col("_start").isNull() | (F.col("_place") > F.col("_start")))
    lists = epochs.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("_place", F.col(epoch).alias("e")))).alias("_e"))
    out = per.join(lists, run, "left")
    values = F.coalesce(F.transform("_e", lambda x: x["e"]), F.array().cast(f"array<{dict(events.dtypes)[epoch]}>"))
    return out.select(run, "starts", F.size(values).cast("long").alias("n_epochs"), values.alias("epochs"))


def cumulative_order(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """`rows` with their place (from 1) in each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))

"""Deterministic order and folds from hashes, in place of library random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_of(group: Column, folds: int) -> Column:
    """Fold of a group, from the first eight hex digits of its MD5."""
    head = F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(folds)).cast("int")


def hash_rank(rows: DataFrame, by: list[str], key: str, out: str = "rank") -> DataFrame:
    """`rows` with their place (from 1) in the MD5 order of `key` within each group of `by`.

    Places are counted in two levels: the number of rows in the group's earlier hash ranges,
    plus the place within the range. A group of any size is thus dealt over 256 ranges.
    """
    placed = rows.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_r", F.substring("_h", 1, 2))
    counts = placed.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_r").orderBy("_h", key)
    ranked = placed.withColumn("_i", F.row_number().over(inside))
    same = [ranked[c].eqNullSafe(counts[c]) for c in [*by, "_r"]]
    joined = ranked.join(counts, on=same, how="left")
    return joined.select(*[ranked[c] for c in rows.columns], (F.col("_i") + F.col("_before")).cast("long").alias(out))

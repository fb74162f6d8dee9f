"""Upserts by key over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row of `columns` (all, if None) for each key: the last in `order`. Rows with a null or empty key part go.

    The last row is found by an aggregation that combines before the shuffle, so a key with
    any number of rows costs one record for each task.
    """
    present = [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]
    columns = rows.columns if columns is None else columns
    whole = F.struct(*[F.col(c).alias(c) for c in columns])
    kept = rows
    for p in present:
        kept = kept.where(p)
    last = kept.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row"))
    # keys by their own name, so that Spark knows how the rows are dealt
    return last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in columns])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`existing` with `incoming` over it: of rows with one key an incoming one wins, the last of them."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, keys, ["_new", *order]).drop("_new")


def field_merge(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row for each key: of each field its last value that is not null. A field that an event
    lacks and one that it sets to null are the same here."""
    place = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields])


def affected(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: inserted, modified (some field differs) and unchanged keys of an upsert. Both inputs
    have one row for each key."""
    old = existing.select(*keys, F.struct(*fields).alias("_old"), F.lit(True).alias("_there"))
    new = incoming.select(*keys, F.struct(*fields).alias("_new"))
    joined = new.join(old, keys, "left")
    there = F.coalesce("_there", F.lit(False))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return joined.agg(F.count_if(~there).alias("n_inserted"), F.count_if(there & ~same).alias("n_modified"), F.count_if(there & same).alias("n_same"))


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often; no rows when they are unique."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def route(events: DataFrame, kind: Column) -> tuple[DataFrame, DataFrame]:
    """Events that are stored: those of epochs, and evaluations. All others are dropped."""
    return events.where(kind == "epoca"), events.where(kind == "estado_gerador")

"""Sinks: tables, event logs and manifests."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: What became of a key in the merge that wrote its row.
INSERTED, MODIFIED, SAME = 0, 1, 2


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet over whatever was there; an earlier generation is gone."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_events(rows: DataFrame, path: str, run_id: str) -> None:
    """JSON lines behind those that are there; an event's own run_id and ts win over the given ones."""
    run = F.coalesce("run_id", F.lit(run_id)) if "run_id" in rows.columns else F.lit(run_id)
    now = F.unix_millis(F.current_timestamp()) / 1000.0
    ts = F.coalesce("ts", now) if "ts" in rows.columns else now
    rows.withColumns({"run_id": run, "ts": ts}).write.mode("append").option("ignoreNullFields", True).json(path)


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, list[int]]]:
    """Number of buckets of a merged table, 0 where there is none, and the versions of each bucket, in order."""
    kinds = [n.removeprefix("buckets=") for n in storage.children(spark, path) if n.startswith("buckets=")]
    if not kinds:
        return 0, {}
    top, found = f"{path}/buckets={kinds[0]}", {}
    for n in storage.children(spark, top):
        if n.startswith("bucket="):
            found[int(n[7:])] = sorted(int(v[8:]) for v in storage.children(spark, f"{top}/{n}") if v.startswith("version="))
    return int(kinds[0]), {b: v for b, v in found.items() if v}


def read_table(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """A merged table as it is now, or some of its buckets; None where there is none. The frame keeps to the files it
    found, which a later merge leaves in place."""
    parts, whole = bucketed_versions(spark, path)
    if whole:
        return spark.read.parquet(f"{path}/parts={parts}/version={whole[-1]}").drop("_state")
    count, versions = _current(spark, path)
    paths = [f"{path}/buckets={count}/bucket={b}/version={v[-1]}" for b, v in sorted(versions.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths).drop("_state") if paths else None


def merge_table(rows: DataFrame, path: str, keys: list[str], by_field: bool = False, buckets: int = 16, keep: int = 1) -> DataFrame:
    """Upsert `rows` (one for each key) into a table; one row says how many keys were inserted,
    modified or the same. With `by_field` a null leaves what was there.

    The table is parted by a hash of the key into `buckets`, a number that is fixed when the table is made. A merge reads
    and writes only the buckets of its keys, each as a new version that replaces the old one by the rename of a folder
    (dynamic partition overwrite). The last `keep` versions before it stay, so that a reader that has begun finishes;
    older ones go. A merge that is stopped between renames has merged some buckets; repeated, it merges the
    rest. One writer at a time: two that meet would take the same version.
    """
    spark = rows.sparkSession
    count, versions = _current(spark, path)
    count = count or buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")
    rows, stage = storage.staged(rows)
    touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most `buckets` numbers
    old = read_table(spark, path, touched)
    version = max((v[-1] for v in versions.values()), default=0) + 1
    fields = [c for c in rows.columns if c not in keys]
    both = rows.withColumn("_new", F.lit(1))
    both = both if old is None else old.withColumn("_new", F.lit(0)).unionByName(both)
    present = lambda k: F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    for k in () if by_field else keys:
        both = both.where(present(k))
    # the old and the new row of a key meet once, and what became of it is written beside it
    whole, was, now = F.struct(*fields), F.col("_was"), F.col("_now")
    met = both.groupBy(*keys).agg(F.max_by(whole, F.when(F.col("_new") == 0, 0)).alias("_was"), F.max_by(whole, F.when(F.col("_new") == 1, 1)).alias("_now"))
    taken = F.struct(*[F.coalesce(now[c], was[c]).alias(c) for c in fields]) if by_field else F.coalesce(now, was)
    met = met.withColumn("_row", taken)
    variants = [c for c, kind in rows.dtypes if kind == "variant"]
    plain = lambda row: F.struct(*[(F.to_json(row[c]) if c in variants else row[c]).alias(c) for c in fields])
    counted = now.isNotNull()
    for k in keys:
        counted = counted & F.col(k).isNotNull()
    state = F.when(~counted, None).when(was.isNull(), INSERTED).when(plain(was).eqNullSafe(plain(F.col("_row"))), SAME).otherwise(MODIFIED)
    placed = met.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns], state.cast("int").alias("_state"), F.lit(count).alias("buckets"), bucket.alias("bucket"), F.lit(version).alias("version"))
    after = placed
    if touched:
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket", "version").parquet(path)
        after = spark.read.schema("_state int").parquet(*[f"{path}/buckets={count}/bucket={b}/version={v[-1]}" for b, v in _current(spark, path)[1].items() if b in touched])
    counts = storage.checkpoint(_told(after))
    storage.delete(spark, stage)
    for b in touched:
        for v in versions.get(b, [])[: -keep or None]:
            storage.delete(spark, f"{path}/buckets={count}/bucket={b}/version={v}")
    return counts


def bucketed_versions(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """Number of parts of a table that merge_bucketed() made, 0 where there is none, and its whole versions, in order."""
    kinds = [n for n in storage.children(spark, path) if n.startswith("parts=")]
    if not kinds:
        return 0, []
    found = [n for n in storage.children(spark, f"{path}/{kinds[0]}") if n.startswith("version=")]
    return int(kinds[0][6:]), sorted(int(n[8:]) for n in found if storage.exists(spark, f"{path}/{kinds[0]}/{n}/_SUCCESS"))


def merge_bucketed(rows: DataFrame, path: str, keys: list[str], parts: int, keep: int = 1) -> DataFrame:
    """Upsert `rows` (one for each key) into a table of which most is to change; one row says how many keys were inserted,
    modified or the same.

    The table is bucketed by its keys into `parts`, a number that is fixed when the table is made, and a merge writes
    it whole, as a new version. What is there is read bucket by bucket and never shuffled; `rows` are, unless they come
    dealt by their keys into as many parts (as those that are read from a table of as many buckets do). Readers of the
    version before finish, as the last `keep` versions before it stay. A version counts when all of it is written, so
    a merge that is stopped changes nothing. One writer at a time. Rows without a key go.
    """
    spark = rows.sparkSession
    count, versions = bucketed_versions(spark, path)
    count, top = count or parts, f"{path}/parts={count or parts}"
    fields = [c for c in rows.columns if c not in keys]
    for k in keys:
        rows = rows.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    names = [f"{kind}_{uuid4().hex}" for kind in ("was", "now")]
    if versions:
        columns = read_table(spark, path).schema.toDDL()
        by, quoted = ", ".join(f"`{k}`" for k in keys), f"{top}/version={versions[-1]}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {names[0]} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {count} BUCKETS LOCATION '{quoted}'")
        there = spark.table(names[0]).select(*keys, F.struct(*fields).alias("_was"))
        met = there.join(rows.select(*keys, F.struct(*fields).alias("_now")).hint("merge"), keys, "full")
        was, now = F.col("_was"), F.col("_now")
        variants = {c for c, kind in rows.dtypes if kind == "variant"}
        text = lambda row, c: F.to_json(row[c]) if c in variants else row[c]
        same = F.lit(True)
        for c in sorted(fields, key=lambda c: c in variants):  # what is cheap to compare first
            same = same & text(was, c).eqNullSafe(text(now, c))
        state = F.when(now.isNull(), None).when(was.isNull(), INSERTED).when(same, SAME).otherwise(MODIFIED)
        row = F.coalesce(now, was)
        rows = met.select(*[F.col(c) if c in keys else row[c].alias(c) for c in rows.columns], state.cast("int").alias("_state"))
    else:
        rows = rows.withColumn("_state", F.lit(INSERTED))
    at = f"{top}/version={max(versions, default=0) + 1}"
    write_bucketed(rows, names[1], keys, count, at)
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # their files stay
    counts = storage.checkpoint(_told(spark.read.schema("_state int").parquet(at)))
    for v in versions[: -keep or None]:
        storage.delete(spark, f"{top}/version={v}")
    return counts


def _told(rows: DataFrame) -> DataFrame:
    told = {"n_inserted": INSERTED, "n_modified": MODIFIED, "n_same": SAME}
    return rows.agg(*[F.count_if(F.col("_state") == v).alias(k) for k, v in told.items()])


def write_bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """A table of the catalog, bucketed and sorted by its keys; returns it. Joins and groupings by these keys read it
    without a shuffle: the physical form of an index. With `path` its files are there, not in the warehouse."""
    writer = rows.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def upsert_bucketed(table: DataFrame, rows: DataFrame, keys: list[str], by_field: bool = False) -> DataFrame:
    """`table` (as write_bucketed() gives it) with `rows` (one for each key) over it. A full outer join by the keys, for
    which only `rows` are shuffled; with `by_field` a null leaves what was there."""
    fields = [c for c in table.columns if c not in keys]
    # merge: a hint for the join that takes both sides in the order of their buckets
    joined = table.alias("o").join(rows.withColumn("_there", F.lit(True)).alias("n").hint("merge"), keys, "full")
    new = F.coalesce("_there", F.lit(False))
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if by_field else F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*keys, *[pick(c).alias(c) for c in fields]).select(*table.columns)


def write_manifests(rows: DataFrame, path: str) -> None:
    """JSON objects, many lines to a file where one file each would burden the file system."""
    rows.write.mode("append").json(path)

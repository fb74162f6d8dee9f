"""Streams whose files come out of order, and tables that are merged under readers."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sondage import storage
from sondage.operators import grouping, merge
from sondage.sources import sinks
from sondage.streaming import runs

KIND = "event_id long, ts timestamp, run long, tipo string, epoca int"


def events(seed, n=400):
    rng = random.Random(seed)
    tipos = ["inicio", "epoca", "epoca", "epoca", "epoca", "estado_gerador", "fim"]
    return [(i, rng.randint(0, 50), rng.randint(1, 6), rng.choice(tipos), rng.choice([None, *range(9)])) for i in range(n)]


def stream_of(spark, folder, rows, files, order):
    frame = spark.createDataFrame(rows, "event_id long, s int, run long, tipo string, epoca int").withColumn("ts", F.timestamp_seconds(F.col("s") * 3600)).select("event_id", "ts", "run", "tipo", "epoca")
    for k in range(files):
        frame.where(order % files == k).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    return frame, spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_of_shuffled_files_is_that_of_the_batch(spark, tmp_path, seed):
    rows = events(seed)
    frame, stream = stream_of(spark, str(tmp_path), rows, 5, F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(5)))
    got = {r["run"]: r for r in runs.fold_runs(stream, str(tmp_path / "out")).collect()}
    want = {r["run"]: r for r in grouping.run_state(frame, "run", "tipo", ["ts", "event_id"], "epoca").collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k]["starts"], got[k]["n_epochs"], got[k]["epochs"]) == (r["starts"], r["n_epochs"], r["epochs"])
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert [k for k, r in got.items() if r["is_current"]] == [[r[2] for r in ordered if r[3] in ("inicio", "epoca")][-1]]
    for k, r in got.items():
        assert r["state_event"] == next((x[0] for x in reversed(ordered) if x[2] == k and x[3] == "estado_gerador"), None)
    # each epoch is written once, with the batch that brings it
    written = spark.read.parquet(str(tmp_path / "out/states")).select(F.explode("epochs").alias("e")).select("e.id")
    assert written.count() == written.distinct().count() <= sum(r[3] == "epoca" for r in rows)


def test_late_events_are_kept(spark, tmp_path):
    days = {0: [10, 10, 12], 1: [11, 9, 13, 2], 2: [2, 13, 30]}
    rows = [(100 * k + i, 24 * d, 1, "epoca", None) for k, ds in days.items() for i, d in enumerate(ds)]
    frame, stream = stream_of(spark, str(tmp_path), rows, 3, F.floor(F.col("event_id") / 100))
    named = stream.withColumn("event_type", F.col("tipo"))
    counts, late = runs.tumbling(named, str(tmp_path / "out"))
    got = {r["start"].day: r["n"] for r in counts.collect()}
    behind = sorted(r["ts"].day for r in late.collect())
    # the second file meets a watermark of day 11, the third one of day 12 (from day 13); day 1 of the epoch is the first
    assert behind == sorted(d + 1 for d in [9, 2, 2]) and got == {11: 2, 12: 1, 13: 1, 14: 2, 31: 1}
    assert sum(got.values()) + len(behind) == frame.count()


def test_repeats_count_once(spark, tmp_path):
    rows = [(1, 10, 1, "epoca", 1), (2, 11, 1, "epoca", 1), (2, 11, 1, "epoca", 1)]
    again = [(2, 11, 1, "epoca", 1), (3, 12, 1, "epoca", 1)]
    frame, _ = stream_of(spark, str(tmp_path / "a"), rows, 1, F.col("event_id"))
    _, _ = stream_of(spark, str(tmp_path / "b"), again, 1, F.col("event_id"))
    counts = None
    for part in ("a", "b"):
        spark.read.parquet(str(tmp_path / part / "in")).drop("part").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")).withColumn("event_type", F.col("tipo"))
        counts, late = runs.tumbling(stream, str(tmp_path / "out"), ident="event_id")
    assert counts.agg(F.sum("n")).first()[0] == 3 and late.count() == 0


def files_of(spark, path, b):
    top = f"{path}/buckets=16/bucket={b}"
    return {f"{v}/{f}" for v in storage.children(spark, top) for f in storage.children(spark, f"{top}/{v}") if f.endswith(".parquet")}


def test_merge_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(1000).select("id", F.lit("old").alias("v"))
    assert tuple(sinks.merge_table(base, path, ["id"]).first()) == (1000, 0, 0)
    reader = sinks.read_table(spark, path)
    bucket = F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")
    few = base.where(bucket == 3).limit(4).withColumn("v", F.lit("new"))
    before = {b: files_of(spark, path, b) for b in range(16)}
    assert tuple(sinks.merge_table(few, path, ["id"]).first()) == (0, 4, 0)
    after = {b: files_of(spark, path, b) for b in range(16)}
    assert {b for b in range(16) if before[b] != after[b]} == {3} and before[3] < after[3]
    assert reader.where("v = 'new'").count() == 0 and reader.count() == 1000  # begun before the merge, it ends after it
    now = sinks.read_table(spark, path)
    assert now.count() == 1000 and now.where("v = 'new'").count() == 4
    assert tuple(sinks.merge_table(few, path, ["id"]).first()) == (0, 0, 4)
    assert len({f.split("/")[0] for f in files_of(spark, path, 3)}) == 2  # the version before the last stays, older ones go
    assert tuple(sinks.merge_table(few.limit(0), path, ["id"]).first()) == (0, 0, 0)


def test_merge_stages_columns(spark, tmp_path):
    """Rows wait as compressed columns, not as a checkpoint, which is many times as large, and their folder goes."""
    shared, path = storage.shared_folder(spark), str(tmp_path / "wide")
    of = lambda: {n for n in storage.children(spark, shared) if n.startswith("staged")}
    files = lambda: sum(f.stat().st_size for f in Path(shared.removeprefix("file:")).rglob("part-*"))
    rows = spark.range(20000).select("id", F.parse_json(F.lit('{"a": [1, 2]}')).alias("p"), F.repeat(F.lit("long text "), 50).alias("v"))
    before, staged = files(), of()
    assert tuple(sinks.merge_table(rows, path, ["id"]).first()) == (20000, 0, 0)
    change = rows.where("id < 30").withColumn("p", F.when(F.col("id") < 10, F.parse_json(F.lit('{"a": [1]}'))).otherwise(F.col("p")))
    assert tuple(sinks.merge_table(change, path, ["id"]).first()) == (0, 10, 20)
    now = sinks.read_table(spark, path)
    assert now.columns == ["id", "p", "v"] and now.count() == 20000
    assert files() - before < 1_000_000 and of() == staged


def test_bucketed_table_is_read_without_a_shuffle(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 250).alias("a"), (F.col("id") >= 250).cast("int").alias("b"), F.col("id").alias("v"), F.lit("x").alias("w"))
    table = sinks.write_bucketed(rows, "by_key", ["a", "b"], 4, str(tmp_path / "by_key"))
    new = spark.createDataFrame([(1, 0, None, "y"), (999, 1, 7, None)], "a long, b int, v long, w string")
    for by_field, want in ((False, {(1, 0): (None, "y"), (999, 1): (7, None), (2, 0): (2, "x")}), (True, {(1, 0): (1, "y"), (999, 1): (7, None), (2, 0): (2, "x")})):
        out = sinks.upsert_bucketed(table, new, ["a", "b"], by_field)
        got = {(r["a"], r["b"]): (r["v"], r["w"]) for r in out.collect()}
        assert len(got) == 501 and all(got[k] == v for k, v in want.items())
    text = sinks.upsert_bucketed(table, new, ["a", "b"])._jdf.queryExecution().sparkPlan().toString()
    plan = sinks.upsert_bucketed(table, new, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in text
    spark.sql("DROP TABLE by_key")


def test_merge_of_a_bucketed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.parse_json(F.lit('{"a": [1, 2]}')).alias("p"), F.lit("old").alias("v"))
    assert tuple(sinks.merge_bucketed(rows, path, ["id"], 4).first()) == (3000, 0, 0)
    reader = sinks.read_table(spark, path)
    n = F.col("id").cast("long")
    change = rows.where(n < 30).withColumns({"p": F.when(n < 10, F.parse_json(F.lit('{"a": 1}'))).otherwise(F.col("p")), "v": F.when(n == 20, "new").otherwise(F.col("v"))})
    more = change.unionByName(rows.limit(1).withColumn("id", F.lit("more"))).unionByName(rows.limit(2).withColumn("id", F.when(F.col("id") == "0", "")))
    assert tuple(sinks.merge_bucketed(more, path, ["id"], 9).first()) == (1, 11, 19)  # the number of parts stays
    assert reader.count() == 3000 and reader.where("v = 'new'").count() == 0  # begun before the merge, it ends after it
    now = sinks.read_table(spark, path)
    assert now.columns == ["id", "p", "v"] and now.count() == 3001 and now.where("v = 'new'").count() == 1
    assert now.where(F.to_json("p") == '{"a":1}').count() == 10
    (tmp_path / "t/parts=4/version=3").mkdir()  # what a merge that was stopped leaves
    assert tuple(sinks.merge_bucketed(rows.limit(0), path, ["id"], 4).first()) == (0, 0, 0)
    assert sinks.read_table(spark, path).count() == 3001 and sinks.bucketed_versions(spark, path) == (4, [2, 3])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("was_", "now_"))]


def test_ingestion_shuffles_narrow_rows_alone(spark):
    from sondage.plans.catalog import QUERIES

    moved = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = moved()
    assert QUERIES["ingest_samples"](spark, "/root/testdata/sf0.001").count() == 6000
    assert moved() - before < 120 * 6000  # more than 500 bytes of each row with its parameters and as text


def test_latest_rows_stay_where_their_keys_were_dealt(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("v"))
    table = sinks.write_bucketed(rows, "dealt", ["id"], 4, str(tmp_path / "dealt"))
    both = merge.latest(table, ["id"], ["v"]).join(table.withColumnRenamed("v", "w").hint("merge"), ["id"], "full")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 100
    spark.sql("DROP TABLE dealt")

"""Event streams: ingestion, folding by run, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import storage


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return storage.new_folder(spark, "stream")


def read(spark: SparkSession, path: str, like: DataFrame | None = None, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet file or folder at `path`, with the schema of `like` or of the files."""
    schema = (spark.read.parquet(path) if like is None else like).schema
    # as a pattern, since a stream takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str, folder: str, put: Callable[[DataFrame, int], None]) -> None:
    """Process all that is there now, batch by batch, from the checkpoint in `folder` on.

    `put` gets each batch and its number and must give the same result when repeated.
    """
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream: DataFrame, folder: str) -> DataFrame:
    """Events with the time of their arrival, appended to a table; returns the table."""
    to = f"{folder}/events"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("recebido_em", F.current_timestamp()).write.mode("overwrite").parquet(f"{to}/batch={number}")

    drain(stream, "append", folder, put)
    return stream.sparkSession.read.parquet(to).drop("batch")


def snapshot_and_tail(stream: DataFrame, folder: str) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """All events there are now, and a function that gives those which have come since it was
    last called. The checkpoint in `folder` keeps the place: nothing is told twice or left out,
    and nothing is dropped for a slow reader."""
    spark, to = stream.sparkSession, f"{folder}/events"
    history = ingest(stream, folder)
    told = [n for n in storage.children(spark, to) if n.startswith("batch=")]

    def more() -> DataFrame:
        ingest(stream, folder)
        new = [n for n in storage.children(spark, to) if n.startswith("batch=") and n not in told]
        told.extend(new)
        return spark.read.schema(history.schema).parquet(*[f"{to}/{n}" for n in new]) if new else history.limit(0)

    return history, more


_FOLDED = "run bigint, starts bigint, n_epochs bigint, since struct<ts: bigint, id: bigint>, epochs array<struct<ts: bigint, id: bigint, epoch: int>>, state struct<ts: bigint, id: bigint>, last struct<ts: bigint, id: bigint>"


class _Runs(StatefulProcessor):
    """Keeps, for each run, how often it has started, when it did last, and which epochs came since: those are
    looked at again only when a start turns out to lie behind some of them. All is ordered by (ts, event_id), not by arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "starts bigint, ts bigint, id bigint, n bigint, sts bigint, sid bigint, lts bigint, lid bigint")
        self.epochs = handle.getListState("epochs", "ts bigint, id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        starts, ts, ident, n, *told = self.run.get() if self.run.exists() else (0, None, None, 0, None, None, None, None)
        since, state, last = ((a, b) if a is not None else None for a, b in ((ts, ident), told[:2], told[2:]))
        keys = list(zip(new["ts"].tolist(), new["event_id"].tolist(), strict=True))
        kinds = new["tipo"].tolist()
        of = lambda *names: [k for k, kind in zip(keys, kinds, strict=True) if kind in names]
        greatest = lambda a, more: max([*([] if a is None else [a]), *more], default=None)
        begun = greatest(since, of("inicio"))
        starts += len(of("inicio"))
        state, last = greatest(state, of("estado_gerador")), greatest(last, of("inicio", "epoca"))
        if begun != since:
            left = [tuple(x) for x in self.epochs.get() if tuple(x) > begun] if self.epochs.exists() else []
            self.epochs.clear()
            if left:
                self.epochs.put(left)
            n, since = len(left), begun
        own = [(*k, None if pd.isna(e) else int(e)) for k, kind, e in zip(keys, kinds, new["epoca"].tolist(), strict=True) if kind == "epoca" and (since is None or k > since)]
        if own:
            self.epochs.appendList([x[:2] for x in own])
            n += len(own)
        pair = lambda x: (None, None) if x is None else x
        self.run.update((starts, *pair(since), n, *pair(state), *pair(last)))
        named = lambda x: None if x is None else {"ts": x[0], "id": x[1]}
        yield pd.DataFrame({"run": [key[0]], "starts": [starts], "n_epochs": [n], "since": [named(since)], "epochs": [[{"ts": a, "id": b, "epoch": e} for a, b, e in own]], "state": [named(state)], "last": [named(last)]})

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"


def fold_runs(stream: DataFrame, folder: str) -> DataFrame:
    """State of each run after all events there are: run, starts, n_epochs, epochs since the last start, state_event (the
    last estado_gerador's event_id; the last wins) and is_current (of the run with the last inicio or epoca of all).

    Events count in the order of (ts, event_id), in whatever files and batches they come, so the result is that of
    grouping.run_state. What a batch writes are its own epochs and the numbers of its runs; state and
    output grow with the batch, not with the runs' past.
    """
    spark, to = stream.sparkSession, f"{folder}/states"
    used = stream.where(F.col("tipo").isin("inicio", "epoca", "estado_gerador")).select("run", F.unix_micros("ts").alias("ts"), "event_id", "tipo", "epoca")
    states = used.groupBy("run").transformWithStateInPandas(_Runs(), _FOLDED, "Update", "None")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        drain(states, "update", folder, put)
    finally:
        spark.conf.set(_STORE, before)
    rows = spark.read.schema(f"{_FOLDED}, batch bigint").parquet(to)
    last = rows.groupBy("run").agg(F.max_by(F.struct("starts", "n_epochs", "since", "state", "last"), "batch").alias("s")).where("s.last is not null").select("run", "s.*")
    epochs = rows.select("run", F.explode("epochs").alias("e")).join(last.select("run", "since"), "run").where("since is null or e.ts > since.ts or (e.ts = since.ts and e.id > since.id)")
    lists = epochs.groupBy("run").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["epoch"]).alias("epochs"))
    current = last.agg(F.max_by("run", F.struct("last", "run")).alias("_current"))
    out = last.join(lists, "run", "left").crossJoin(F.broadcast(current))
    return out.select("run", "starts", "n_epochs", F.coalesce("epochs", F.array().cast("array<int>")).alias("epochs"), F.col("state.id").alias("state_event"), (F.col("run") == F.col("_current")).alias("is_current"))


def tumbling(stream: DataFrame, folder: str, width: str = "1 day", late: str = "1 day", ident: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts (start, event_type, n) of events by window and type, windows that are still open among them, and the events that came
    too late. With `ident` repeats of an event count once, as long as the watermark has not passed them.

    An event is late when the watermark, the greatest ts of earlier batches less `late`, has passed the end of its
    window. Spark drops such rows without a word, so each batch is parted before it is counted: what is late goes to a table of
    its own, and nothing is lost: counts and late events together are all events. A batch writes the counts
    of its own events, which add up; the watermark of each batch is kept beside them, so that a
    batch that is repeated parts its events alike.
    """
    spark, kind = stream.sparkSession, stream.schema

    def watermark(number: int) -> DataFrame:
        """One row: the watermark for a batch, null for the first."""
        marks = spark.read.schema("mark timestamp, batch bigint").parquet(f"{folder}/marks") if storage.exists(spark, f"{folder}/marks") else spark.createDataFrame([], "mark timestamp, batch bigint")
        return marks.where(F.col("batch") < number).agg((F.max("mark") - F.expr(f"interval {late}")).alias("_mark"))

    def put(batch: DataFrame, number: int) -> None:
        parted = storage.checkpoint(batch.withColumn("_window", F.window("ts", width)).crossJoin(F.broadcast(watermark(number))))
        behind = F.coalesce(F.col("_window.end") <= F.col("_mark"), F.lit(False))
        parted.where(behind).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        fresh = parted.where(~behind)
        if ident:
            fresh = fresh.dropDuplicates([ident])
            if storage.exists(spark, f"{folder}/seen"):
                seen = spark.read.schema(f"{ident} {dict(stream.dtypes)[ident]}, ts timestamp, batch bigint").parquet(f"{folder}/seen").where(F.col("batch") < number)
                fresh = fresh.join(seen.crossJoin(F.broadcast(watermark(number))).where("_mark is null or ts >= _mark").select(ident), ident, "left_anti")
            fresh = storage.checkpoint(fresh)
            fresh.select(ident, "ts").write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        counts = fresh.groupBy(F.col("_window.start").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")
        parted.agg(F.max("ts").alias("mark")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    drain(stream, "append", folder, put)
    counts = spark.read.schema("start timestamp, event_type string, n bigint, batch bigint").parquet(f"{folder}/windows")
    behind = spark.read.schema(kind).parquet(f"{folder}/late")
    return counts.groupBy("start", "event_type").agg(F.sum("n").alias("n")), behind


def once(stream: DataFrame, ident: str, late: str = "1 day") -> DataFrame:
    """The stream without repeats of `ident` that arrive within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([ident])


def sessions(rows: DataFrame, by: str, gap: str = "30 minutes") -> DataFrame:
    """start, by and n of sessions of events at most `gap` apart; for batches and streams."""
    return rows.groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), by, "n")

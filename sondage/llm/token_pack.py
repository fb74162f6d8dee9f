"""Token ids packed into matrices for training.

Texts are encoded, documents over `length` tokens are split without loss into pieces of
`length` and a remainder, and pieces are packed best-fit-decreasing: in order of falling
size, each goes into the row with the least room that still holds it. A segment tree over
the amounts of room finds that row in log2(length) steps. Each packed row carries its ids
(little-endian, padded), its number of tokens, the cumulative lengths of its segments,
position ids that start anew at each segment, and which document piece each segment is.

Packing is local to a task's window of about `window_tokens` tokens, so memory is bounded,
nothing is shuffled, and a lost task is simply done again with the same result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

SCHEMA = "shard int, block int, row int, n_tokens int, ids binary, cumulative array<int>, positions binary, segments array<struct<doc_id:long,piece:int,tokens:int>>"
_SEGMENT = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int32())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RoomTree:
    """Rows by the room left in them; finds the least room that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.some = [0] * (2 * self.size)  # how many rows below each node
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        at = self.size + room
        while at:
            self.some[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room of `need` or more, taken out of the tree."""
        at = self.size + need
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.some[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item indexes by best fit in order of falling size; equal sizes in given order."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room, row = tree.take(sizes[i]) or (length, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


def _window(shard: int, block: int, items: list[tuple[int | None, int, np.ndarray]], length: int, kind: str, pad: int) -> pa.RecordBatch:
    rows = pack([len(x) for _, _, x in items], length)
    out = {name: [] for name in ("n_tokens", "ids", "cumulative", "positions", "segments")}
    count = np.arange(length, dtype=np.int32)
    for own in rows:
        ids, positions, edges, at = np.full(length, pad, dtype=kind), np.zeros(length, dtype="<i4"), [0], 0
        for i in own:
            x = items[i][2]
            ids[at : at + len(x)] = x
            positions[at : at + len(x)] = count[: len(x)]
            at += len(x)
            edges.append(at)
        out["n_tokens"].append(at)
        out["ids"].append(ids.tobytes())
        out["cumulative"].append(edges)
        out["positions"].append(positions.tobytes())
        out["segments"].append([{"doc_id": items[i][0], "piece": items[i][1], "tokens": len(items[i][2])} for i in own])
    n = len(rows)
    kinds = {"n_tokens": pa.int32(), "ids": pa.binary(), "cumulative": pa.list_(pa.int32()), "positions": pa.binary(), "segments": pa.list_(_SEGMENT)}
    columns = [pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()), *(pa.array(out[k], t) for k, t in kinds.items())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "row", *kinds])


def packed(documents: DataFrame, path: str | None = None, length: int = 2048, pad: int = 0, window_tokens: int = 2_000_000) -> DataFrame:
    """Packed rows of all texts (see SCHEMA).

    ids: `length` token ids, uint16 where the vocabulary fits and else uint32; positions:
    `length` int32; both padded behind n_tokens. A document's pieces in order of `piece`
    give back its ids. Null and empty texts have no tokens and no segment. Repeated rows are
    packed each; a null doc_id stays null; other columns are left out, whatever their names. Special tokens'
    spellings in a text are ordinary text. A very long text is cut into pieces of at most `length` tokens, none of
    which is lost; an empty table gives no rows.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    ranks = read_ranks(path or default_path())
    kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from public_tokenizers import PATTERN

        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        shard, block, items, held = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.array(coder.encode_ordinary(text.as_py() or ""), dtype=kind)
                for piece, at in enumerate(range(0, len(ids), length)):
                    items.append((doc, piece, ids[at : at + length]))
                held += len(ids)
                if held >= window_tokens:
                    yield _window(shard, block, items, length, kind, pad)
                    block, items, held = block + 1, [], 0
        if items:
            yield _window(shard, block, items, length, kind, pad)

    T.small_batches(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(T.lean(run), SCHEMA)


def write(rows: DataFrame, folder: str) -> None:
    """Packed rows as Parquet with binary matrices rows, one file for each shard."""
    rows.write.mode("overwrite").parquet(folder)


def unpack(rows: DataFrame, length: int = 2048) -> DataFrame:
    """doc_id and ids (array<int>) of each document with tokens, put together again from packed rows."""
    wide = F.length("ids") / length
    at = F.transform(F.sequence(F.lit(0), F.size("segments") - 1), lambda i: F.struct(i.alias("i"), F.col("segments")[i].alias("s"), F.col("cumulative")[i].alias("at")))
    parts = rows.select("ids", wide.cast("int").alias("wide"), F.explode(at).alias("x"))
    piece = F.expr("substring(ids, x.at * wide + 1, x.s.tokens * wide)")
    whole = parts.select(F.col("x.s.doc_id").alias("doc_id"), F.struct(F.col("x.s.piece").alias("piece"), piece.alias("raw"), "wide").alias("p"))
    joined = whole.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.concatenate([np.frombuffer(p["raw"], "<u2" if p["wide"] == 2 else "<u4") for p in ps]).astype(np.int32) for ps in b.column("ps").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return joined.mapInArrow(T.lean(run), "doc_id long, ids array<int>")


def op3_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into rows of 2048 ids."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

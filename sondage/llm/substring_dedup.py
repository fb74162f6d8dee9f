"""Substring dedup: words in passages that a smaller document has too are removed.

A passage is a window of `window` consecutive words. Windows are found through
difference-cover anchors: with a difference cover D of the residues modulo `period`,
any two equal windows, wherever they stand, have a shift below `period` at which both
positions fall on D. So only runs of `window - period + 1` words that start at a
position of D modulo `period` are hashed (3 of 7 positions by default), and each equal
pair of windows shares such an anchor. Anchors that more than one document has are then
extended: the windows around them are compared as a whole, by 95 bits that come from two
XXH64 of each word with different seeds.

Documents are dealt to chunks of about `chunk_bytes` by a hash of doc_id and text. A chunk sends
each of its different anchors once, and later each candidate window once with its
smallest doc_id, in packed blocks by hash range; the answers come back by chunk. So a
passage that a third of all documents share costs one record for each chunk, no key can
fill a task, and no pairs are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

U = T.U
LAST = np.iinfo(np.int64).max
PACKED = "bucket int, chunk int, hash binary, more binary, doc binary"
REPLY = "chunk int, hash binary, more binary, doc binary"
MARKS = "chunk int, bucket int, n int, marks binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
SECOND = np.uint32


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues modulo `period`."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("period must be at least 1")


class Lookup:
    """Membership in sorted 64-bit keys, by a small table of bytes before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(10, math.ceil(math.log2(16 * len(keys) + 1)))
        self.mask = U((1 << min(bits, 27)) - 1)
        self.table = np.zeros(int(self.mask) + 1, dtype=bool)
        self.table[keys & self.mask] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of those of x that are keys, and the keys' indexes."""
        maybe = np.flatnonzero(self.table[x & self.mask])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.keys, x[maybe]), len(self.keys) - 1)
        good = self.keys[at] == x[maybe]
        return maybe[good], at[good]


class Plan:
    """Parameters of a run, as every task needs them."""

    def __init__(self, window: int, period: int, buckets: int, block_bytes: int):
        if not 1 <= period <= window:
            raise ValueError("period must be from 1 to window")
        self.window, self.period, self.block_bytes = window, period, block_bytes
        self.cuts = np.array([((1 << 64) * k + buckets - 1) // buckets for k in range(buckets)], dtype=U)
        self.anchor = window - period + 1
        self.on_cover = np.zeros(period, dtype=bool)
        self.on_cover[list(difference_cover(period))] = True

    def blocks(self, table: pa.Table) -> Iterator[tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]]:
        """Words of each block, the text of each word, its index there, and the prefix hash."""
        texts = T.byte_list(table["text"])
        for low, high in T.spans(texts, self.block_bytes):
            words = T.Words(texts[low:high], T.NOT_SPACE)
            owner = words.text_of()
            yield words, owner + low, np.arange(words.n) - words.first[:-1][owner], T.sequence_prefix(words.hashes())

    def anchors(self, words: T.Words, owner: np.ndarray, place: np.ndarray, prefix: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Word indexes of the anchors and their hashes (the lowest bit is free)."""
        room = words.counts[owner - low] - self.anchor
        at = np.flatnonzero(self.on_cover[place % self.period] & (place <= room))
        return at, T.sequence_hash(prefix, at, self.anchor) & ~U(1)

    def deal(self, chunk: int, hashes: np.ndarray, more: np.ndarray | None = None, docs: np.ndarray | None = None) -> pa.Table:
        """Packed rows of sorted hashes by hash range."""
        cuts = np.append(np.searchsorted(hashes, self.cuts), len(hashes))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        pieces = list(zip(full.tolist(), cuts[full].tolist(), cuts[full + 1].tolist(), strict=True))
        cut = lambda x: [None if x is None else x[a:b].tobytes() for _, a, b in pieces]
        return pa.table([pa.array([k for k, _, _ in pieces], pa.int32()), pa.array([chunk] * len(pieces), pa.int32()), *(pa.array(cut(x), pa.binary()) for x in (hashes, more, docs))], names=_NAMES)


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(LAST).to_numpy()


def _unpack(table: pa.Table, name: str, kind=U) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype=kind)


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs, from where each begins."""
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new)))


def _first_of(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _own_anchors(plan: Plan, table: pa.Table) -> np.ndarray:
    """A chunk's different anchors, sorted; the lowest bit says that two of its documents have it."""
    ids, found, docs, low = _ids(table), [np.empty(0, U)], [np.empty(0, np.int64)], 0
    for words, owner, place, prefix in plan.blocks(table):
        at, hashes = plan.anchors(words, owner, place, prefix, low)
        found.append(hashes)
        docs.append(ids[owner[at]])
        low += len(words.counts)
    hashes, docs = np.concatenate(found), np.concatenate(docs)
    order = np.argsort(hashes)
    hashes, docs = hashes[order], docs[order]
    start, _ = _runs(_first_of(hashes))
    if not len(start):
        return hashes
    several = np.minimum.reduceat(docs, start) < np.maximum.reduceat(docs, start)
    return hashes[start] | several.astype(U)


def _send_anchors(plan: Plan, table: pa.Table) -> pa.Table:
    out = plan.deal(table["chunk"][0].as_py(), _own_anchors(plan, table))
    T.tidy()
    return out


def _by_chunk(chunks: np.ndarray, *columns: np.ndarray) -> pa.Table:
    order = np.argsort(chunks, kind="stable")
    chunks = chunks[order]
    start, size = _runs(_first_of(chunks))
    packed = []
    for c in columns:
        own = c[order]
        packed.append([own[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)])
    packed += [[None] * len(start)] * (3 - len(columns))
    return pa.table([pa.array(chunks[start], pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=_NAMES[1:])


def _chunks_of(table: pa.Table) -> np.ndarray:
    sizes = [len(x) // 8 for x in table["hash"].to_pylist()]
    return np.repeat(table["chunk"].to_numpy().astype(np.int32), sizes)


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For each chunk's anchors of this range, in the order sent, a bit: another document has it too."""
    hashes = _unpack(table, "hash")
    keep = (hashes & U(1)).astype(bool)
    hashes = hashes & ~U(1)
    order = np.argsort(hashes)
    start, size = _runs(_first_of(hashes[order]))
    keep[order] |= np.repeat(size > 1, size)
    sizes = [len(x) // 8 for x in table["hash"].to_pylist()]
    edge = np.concatenate(([0], np.cumsum(sizes))).tolist()
    marks = [np.packbits(keep[a:b]).tobytes() for a, b in zip(edge, edge[1:], strict=False)]
    return pa.table([table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())], names=["chunk", "bucket", "n", "marks"])


def _marked(hashes: np.ndarray, marks: pa.Table) -> np.ndarray:
    """Of a chunk's sorted anchors those that are marked."""
    rows = sorted(zip(marks["bucket"].to_pylist(), marks["n"].to_pylist(), marks["marks"].to_pylist(), strict=True))
    keep = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for _, n, m in rows]
    return hashes[np.concatenate(keep).astype(bool)] & ~U(1) if keep else hashes[:0]


def _send_windows(plan: Plan, table: pa.Table, shared: pa.Table) -> pa.Table:
    """A chunk's different windows around shared anchors, each with its smallest doc_id; the
    lowest bit of the hash says that another of its documents has it too."""
    if not table.num_rows:
        return plan.deal(0, np.empty(0, U))
    ids, known = _ids(table), Lookup(_marked(_own_anchors(plan, table), shared))
    parts, low = [(np.empty(0, U), np.empty(0, SECOND), np.empty(0, np.int64))], 0
    for words, owner, place, prefix in plan.blocks(table) if len(known.keys) else ():
        at, hashes = plan.anchors(words, owner, place, prefix, low)
        at = at[known.find(hashes)[0]]
        own = owner[at] - low
        first, last = words.first[own], words.first[own] + words.counts[own] - plan.window
        a, b = np.maximum(at - plan.period + 1, first), np.minimum(at, last)
        a, b = a[a <= b], b[a <= b]
        near = np.cumsum(np.bincount(a, minlength=words.n + 1) - np.bincount(b + 1, minlength=words.n + 1))
        start = np.flatnonzero(near[: words.n] > 0)
        parts.append((T.sequence_hash(prefix, start, plan.window) & ~U(1), _second(words, start, plan), ids[owner[start]]))
        low += len(words.counts)
    hashes, more, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((more, hashes))
    hashes, more, docs = hashes[order], more[order], docs[order]
    start, _ = _runs(_first_of(hashes, more))
    if not len(start):
        return plan.deal(0, hashes, more, docs)
    least = np.minimum.reduceat(docs, start)
    several = least < np.maximum.reduceat(docs, start)
    out = plan.deal(table["chunk"][0].as_py(), hashes[start] | several.astype(U), more[start], least)
    T.tidy()
    return out


def _second(words: T.Words, start: np.ndarray, plan: Plan) -> np.ndarray:
    """32 more bits for each window, from the bytes of its words hashed with another seed."""
    edge = np.bincount(start, minlength=words.n + 1) - np.bincount(start + plan.window, minlength=words.n + 1)
    used = np.flatnonzero(np.cumsum(edge)[: words.n])
    hashes = np.zeros(words.n, dtype=U)
    hashes[used] = T.xxh64(words.data, words.start[used], words.size[used], 0x9E3779B1)
    return (T.sequence_hash(T.sequence_prefix(hashes, 1), start, plan.window, 1) >> U(32)).astype(SECOND)


def _smallest(table: pa.Table) -> pa.Table:
    """Windows with the smallest doc_id of all, to each chunk with a greater one."""
    chunks, hashes, more, docs = _chunks_of(table), _unpack(table, "hash"), _unpack(table, "more", SECOND), _unpack(table, "doc", np.int64)
    several = (hashes & U(1)).astype(bool)
    hashes = hashes & ~U(1)
    order = np.lexsort((more, hashes))
    chunks, hashes, more, docs, several = (x[order] for x in (chunks, hashes, more, docs, several))
    start, size = _runs(_first_of(hashes, more))
    least = np.repeat(np.minimum.reduceat(docs, start), size)
    tell = (least < docs) | several
    return _by_chunk(chunks[tell], hashes[tell], more[tell], least[tell])


def _cut(plan: Plan, table: pa.Table, reply: pa.Table) -> pa.Table:
    ids = _ids(table)
    hashes, more, least = _unpack(reply, "hash"), _unpack(reply, "more", SECOND), _unpack(reply, "doc", np.int64)
    order = np.lexsort((more, hashes))
    hashes, more, least = hashes[order], more[order], least[order]
    # windows of equal first hash but other second: kept apart by looking at each in turn
    start, size = _runs(_first_of(hashes))
    known, longest = Lookup(hashes[start]), int(size.max()) if len(size) else 0
    counts, removed, kept, low = [], [], [], 0
    for words, owner, place, prefix in plan.blocks(table):
        n = len(words.counts)
        gone = np.zeros(words.n, dtype=bool)
        if longest:
            at = np.flatnonzero(place <= words.counts[owner - low] - plan.window)
            got, key = known.find(T.sequence_hash(prefix, at, plan.window) & ~U(1))
            at = at[got]
            if len(at):
                second = _second(words, at, plan)
                cover = np.zeros(len(at), dtype=bool)
                for k in range(longest):
                    row = np.minimum(start[key] + k, len(hashes) - 1)
                    cover |= (k < size[key]) & (more[row] == second) & (least[row] < ids[owner[at]])
                at = at[cover]
                edge = np.bincount(at, minlength=words.n + 1) - np.bincount(at + plan.window, minlength=words.n + 1)
                gone = np.cumsum(edge)[: words.n] > 0
        joined, place_in = words.joined()
        cut = np.bincount(owner[gone] - low, minlength=n)
        if cut.any():
            joined = joined[np.repeat(~gone, words.size + 1)]
            sizes = np.where(gone, 0, words.size + 1)
            place_in = np.zeros(words.n + 1, dtype=np.int64)
            np.cumsum(sizes, out=place_in[1:])
        raw, edges = joined.tobytes(), place_in[words.first].tolist()
        kept += [raw[a : max(a, b - 1)] for a, b in zip(edges, edges[1:], strict=False)]
        counts.append(words.counts)
        removed.append(cut)
        low += n
    T.tidy()
    whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (counts, removed)]
    return pa.table([table["doc_id"].combine_chunks(), pa.array(whole[0], pa.int64()), pa.array(whole[1], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def dedup(documents: DataFrame, window: int = 13, period: int = 7, chunk_bytes: int = 24 << 20, block_bytes: int = 512 << 10) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of each row.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if it is in a window whose words also
    start in a row with a smaller doc_id; windows are judged on the input. Null and wordless
    texts have no words and an empty kept_text. A null doc_id stands after every other; rows
    of one doc_id don't cut each other. Other columns are left out, whatever their names. An
    empty table gives no rows. A very long text is one row of a chunk like any other: it is read as
    a whole, by one task. Words count as equal by two hashes with different seeds, not by
    their bytes. One pass over the lengths of the texts sets the number of chunks; hash ranges
    take the anchors of about four chunks each.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    chunks = max(least, math.ceil(size / chunk_bytes))
    plan = Plan(window, period, max(least, math.ceil(chunks / 4)), block_bytes)
    # by the text too, so that rows without a doc_id or with one that repeats are dealt over many chunks
    dealt = documents.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInArrow(lambda t: _send_anchors(plan, t), PACKED)
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, MARKS)
    windows = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(lambda a, b: _send_windows(plan, a, b), PACKED)
    smallest = windows.groupBy("bucket").applyInArrow(_smallest, REPLY)
    return by_chunk.cogroup(smallest.groupBy("chunk")).applyInArrow(lambda a, b: _cut(plan, a, b), "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of thirteen words over all documents."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS ord, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT ord, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
hit AS (SELECT ord, i FROM (SELECT ord, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT ord, p FROM (SELECT ord, unnest(range(i, i + 13)) AS p FROM hit)),
word AS (SELECT ord, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT word.ord, string_agg(word.word, ' ' ORDER BY word.p) AS kept, count(*) AS n
  FROM word ANTI JOIN gone ON word.ord = gone.ord AND word.p = gone.p GROUP BY word.ord)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.ord = kept.ord
"""

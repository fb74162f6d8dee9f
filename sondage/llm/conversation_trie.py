"""Prefix trie of rebuilt conversations: families first, then one merging of their nodes.

A conversation takes its first turns from the base of its family, so that shared beginnings are found
within families. Rows are brought together by base id and read in order, base first: a task rebuilds the
conversations of one family after another and keeps the family's small trie, whose nodes are known by a
128-bit hash of the turns that lead to them. Only the combined nodes of families are shuffled
for the global merging; texts move once, to their family.

Sums over subtrees need no walk through levels. The smallest member of a node owns it; a conversation owns the
end of its path, from some depth on. So the bytes of distinct nodes below a node are, for each of its members, the
bytes of what that member owns there, and the childless nodes below it are the members that own a childless
end. Both sums go over members of family nodes and combine before the shuffle.

Long conversations pass through in order and a full family trie is handed on in parts, so that memory doesn't grow
with them. The ids that end in one node are joined in blocks by ranges of ids; the blocks are hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint

ROOT = bytes(16)
_FAMILY_NODE = "family long, node binary, parent binary, depth long, bytes long, before long, convs array<long>, ends array<long>"
_TYPES = pa.schema([("family", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("before", pa.int64()), ("convs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


class _Family:
    """The trie of one family, as far as its rows have come: node -> [parent, depth, bytes of its last text, bytes
    before that, members, members that end here]."""

    def __init__(self, heads: int):
        self.heads, self.head, self.nodes, self.conv, self.family = heads, [], {}, None, None

    def _visit(self, node: bytes, parent: bytes | None, depth: int, size: int, before: int) -> None:
        self.nodes.setdefault(node, [parent, depth, size, before, [], []])[4].append(self.conv)
        self.at = (node, parent, depth, size, before)

    def step(self, role: str, text: str) -> None:
        parent, _, depth, size, before = self.at
        role, text = role.encode(), text.encode()
        node = hashlib.blake2b(b"%b%d:%b%b" % (parent, len(role), role, text), digest_size=16).digest()
        self._visit(node, parent, depth + 1, len(text), before + size)

    def begin(self, conv: int, own: bool, shared: int) -> None:
        """own: not the base of the family, but one whose first `shared` turns are the base's."""
        self.conv, self.skip = conv, shared if own else 0
        self._visit(ROOT, None, 0, 0, 0)
        if own:
            for turn in self.head[:shared]:
                self.step(*turn)

    def turn(self, own: bool, role: str, text: str) -> None:
        if not own and len(self.head) < self.heads:
            self.head.append((role, text))
        if self.skip:
            self.skip -= 1
        else:
            self.step(role, text)

    def end(self) -> None:
        if self.conv is not None:
            node, *rest = self.at
            self.nodes.setdefault(node, [*rest, [], []])[5].append(self.conv)
            self.conv = None

    def rows(self) -> pa.RecordBatch:
        parts = list(zip(*((self.family, k, *v) for k, v in self.nodes.items()), strict=True))
        self.nodes = {}
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, _TYPES.types, strict=True)], schema=_TYPES)


def family_nodes(conversations: DataFrame, family: int = 5, heads: int = 9, most_nodes: int = 20_000) -> DataFrame:
    """Combined nodes of each family (see _FAMILY_NODE); a trie of over `most_nodes` nodes comes in parts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")).where("conv_id is not null")
    base = F.col("conv_id") - F.col("conv_id") % family
    shared = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    rows = rows.withColumns({"family": base, "own": F.col("conv_id") != base, "shared": shared})
    together = rows.repartition("family").sortWithinPartitions("family", "own", "conv_id", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done, count = _Family(heads), [], 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("family", "own", "conv_id", "shared", "role", "text")]
            for base, own, conv, shared, role, text in zip(*columns, strict=True):
                if base != state.family:
                    state.end()
                    if state.nodes:
                        done.append(state.rows())
                        count += done[-1].num_rows
                    state.family, state.head = base, []
                if conv != state.conv:
                    state.end()
                    state.begin(conv, own, shared)
                state.turn(own, role, text)
                if len(state.nodes) > most_nodes:
                    done.append(state.rows())
                    count += done[-1].num_rows
                if count > 5000:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done, count = [], 0
        state.end()
        if state.nodes:
            done.append(state.rows())
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return together.select("family", "own", "conv_id", "shared", "role", "text").mapInArrow(run, _FAMILY_NODE)


def _digests(ends: DataFrame, block: int = 65_536) -> DataFrame:
    """node, ends_sha256 of (node, conv): SHA-256 of the decimal ids in order, joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []
        for b in batches:
            for n, c in zip(b.column("node").to_pylist(), b.column("conv").to_pylist(), strict=True):
                if n != node or size > block:
                    if ids:
                        out.append((node, ids[0], ",".join(map(str, ids))))
                    node, ids, size = n, [], 0
                ids.append(c)
                size += 12
                if len(out) >= 2000:
                    yield _batch(out, ("node", "first", "ids"))
                    out = []
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
        if out:
            yield _batch(out, ("node", "first", "ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for b in batches:
            for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if n == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256()
                sha.update(ids.encode())
            if len(out) >= 2000:
                yield _batch(out, ("node", "ends_sha256"))
                out = []
        if node is not None:
            out.append((node, sha.hexdigest()))
        if out:
            yield _batch(out, ("node", "ends_sha256"))

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = ends.repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(join, "node binary, first long, ids string")
    return blocks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=list(names))


def trie(conversations: DataFrame, family: int = 5, heads: int = 9, most_nodes: int = 20_000) -> DataFrame:
    """node and parent (hashes, binary; root: 16 zero bytes, its parent null), conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie of all rebuilt conversations.

    `conversations` has conv_id, turn, role and text; other columns are left out, whatever their names. Turns are in the
    order of turn (null first), ties of role and text; rows that are equal in all of them are turns of their own. A null
    role or text is empty; rows with a null conv_id take no part. Conversation c takes the first h turns of
    conversation c - c % `family` (the remainder has the sign of c) before its own turns after its first h, with
    h = crc32(c as text) % `heads`. Long texts and conversations of many turns pass through. An empty
    table gives no rows, not even a root.
    """
    parts = checkpoint(family_nodes(conversations, family, heads, most_nodes))
    merged = parts.groupBy("node").agg(
        F.min(F.array_min("convs")).alias("conv_id"),
        F.sum(F.size("convs").cast("long")).alias("n_convs"),
        *[F.max(c).alias(c) for c in ("parent", "depth", "bytes")],
    )
    children = F.col("parent").isNotNull()
    merged = checkpoint(merged)
    counts = merged.where(children).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = checkpoint(merged.join(counts, "node", "left").fillna(0, ["n_children"]))
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("bytes").alias("own"), F.max_by(F.col("n_children") == 0, "depth").alias("leaf"))
    # a row for each conversation, then one for each family, of `family` conversations at most
    totals = parts.select("family", F.explode("ends").alias("conv_id"), (F.col("before") + F.col("bytes")).alias("total"))
    facts = totals.join(owned, "conv_id", "left").groupBy("family").agg(F.collect_list(F.struct("conv_id", "total", "since", "own", "leaf")).alias("facts"))
    met = parts.select("family", "node", "depth", "before", "convs").join(facts, "family")
    below = lambda c: F.when(c["since"].isNull() | (F.col("depth") <= c["since"]), c["total"] - F.col("before") - F.coalesce(c["own"], F.lit(0))).otherwise(F.lit(0))
    members = F.filter("facts", lambda c: F.array_contains("convs", c["conv_id"]))
    met = met.withColumn("_members", members).select(
        "node",
        F.aggregate("_members", F.lit(0).cast("long"), lambda s, c: s + below(c)).alias("saved"),
        F.size(F.filter("_members", lambda c: F.coalesce(c["leaf"], F.lit(False)))).cast("long").alias("leaves"),
    )
    sums = met.groupBy("node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = _digests(parts.select("node", F.explode("ends").alias("conv")))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(ends, "node", "left").join(above, "parent", "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT b, 0 AS k, CAST(b AS UBIGINT) AS c FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS MATERIALIZED (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM turns GROUP BY conv_id),
h AS MATERIALIZED (
  SELECT conv_id, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 9 AS BIGINT) AS h
  FROM conv, tab),
rebuilt AS MATERIALIZED (
  SELECT c.conv_id, CASE WHEN c.conv_id % 5 = 0 THEN c.turns ELSE list_concat(coalesce(b.turns[1 : h], []), c.turns[h + 1 :]) END AS turns
  FROM conv c JOIN h USING (conv_id) LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 5),
path AS MATERIALIZED (
  SELECT conv_id, d, d = len(turns) AS ends, CASE WHEN d = 0 THEN '' ELSE sha256(CAST(to_json(turns[1 : d]) AS VARCHAR)) END AS node,
    CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE sha256(CAST(to_json(turns[1 : d - 1]) AS VARCHAR)) END AS parent,
    CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].text) END AS bytes
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
node AS MATERIALIZED (
  SELECT node, any_value(parent) AS parent, d, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM path GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY 1),
below AS (SELECT DISTINCT p.node AS top, q.node AS node FROM path p JOIN path q ON p.conv_id = q.conv_id AND p.d <= q.d),
sums AS (
  SELECT top AS node, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (WHERE coalesce(kids.n, 0) = 0) AS leaves
  FROM below JOIN node USING (node) LEFT JOIN kids USING (node) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN node p ON p.node = n.parent
"""

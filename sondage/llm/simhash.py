"""SimHash fingerprints and near duplicates through a Gray-order hierarchical index.

Different fingerprints are dealt to buckets by a key that near ones share. In a bucket they
stand by Gray rank, so neighbours share most bits. Groups of neighbours become nodes:
a node keeps the bits that all below it share, without those that its own parent
already keeps. A search walks down from the roots and adds up the differences to
each node's bits; when the sum passes the radius, the whole group is dropped.
Searches of many fingerprints go down together, level by level, in arrays.

A bucket gives links from each fingerprint to one of its group in the bucket, never all
pairs; the groups of all buckets are then joined by connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .components import checkpoint, components

U = T.U
FANOUT = 8
_LANES = U(0x0001000100010001)


def shingle_hashes(texts: list[bytes], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, text after text, and how many each text has."""
    words = T.Words(texts, T.NOT_SPACE, lower=True)
    joined, at = words.joined()
    n = np.where(words.counts >= size, words.counts - size + 1, (words.counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(n, out=begin[1:])
    first = words.first[owner] + np.arange(begin[-1]) - begin[owner]
    last = np.minimum(first + size, words.first[owner + 1])
    return T.xxh64(joined, at[first], at[last] - 1 - at[first], seed), n


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that are set in over half of them."""
    out = np.zeros(len(counts), dtype=U)
    begin = np.concatenate(([0], np.cumsum(counts)))
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    pieces = np.maximum(1, -(-counts[own] // 60_000))  # sums of 16 bits must not overflow
    start = np.concatenate([begin[i] + 60_000 * np.arange(k) for i, k in zip(own, pieces, strict=True)]) if pieces.max() > 1 else begin[own]
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    for k in range(16):
        sums = np.add.reduceat((hashes >> U(k)) & _LANES, start)
        for lane in range(4):
            total = np.add.reduceat(((sums >> U(16 * lane)) & U(0xFFFF)).astype(np.int64), first)
            out[own] |= (2 * total > counts[own]).astype(U) << U(k + 16 * lane)
    return out


def fingerprints(documents: DataFrame, shingle: int = 3, seed: int = 42, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and the 64-bit fingerprint (long) of each row.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text with fewer words than
    `shingle` is one shingle; null and wordless texts have fingerprint 0. Each shingle counts
    as often as it occurs. Other columns are left out, whatever their names; rows are independent. A very long text is
    read as a whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = T.byte_list(b.column("text"))
            prints = [majority(*shingle_hashes(texts[i:j], shingle, seed)) for i, j in T.spans(texts, block_bytes)]
            column = pa.array(np.concatenate(prints).view(np.int64) if prints else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), column], names=["doc_id", "fingerprint"])

    T.small_batches(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(T.lean(run), "doc_id long, fingerprint long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class GrayIndex:
    """A forest, one tree for each bucket, over fingerprints sorted by (bucket, Gray rank)."""

    def __init__(self, buckets: np.ndarray, prints: np.ndarray):
        """levels: from the roots down to the fingerprints; of each node its bits, which of
        them it keeps itself, and its children's range in the next level."""
        bits, shared, groups = prints, np.full(len(prints), ~U(0), dtype=U), buckets
        levels = [[bits, shared, None]]
        while True:
            new = np.ones(len(groups), dtype=bool)
            new[1:] = groups[1:] != groups[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(groups)))
            if size.max(initial=1) == 1 and len(levels) > 1:
                break
            place = np.arange(len(groups)) - np.repeat(start, size)
            begin = np.flatnonzero(place % FANOUT == 0)
            all_one = np.bitwise_and.reduceat(bits, begin)
            any_one = np.bitwise_or.reduceat(bits, begin)
            kept = np.bitwise_and.reduceat(shared, begin) & ~(all_one ^ any_one)
            children = np.diff(np.append(begin, len(groups)))
            levels[-1][1] = shared & ~np.repeat(kept, children)
            levels.append([all_one & kept, kept, np.stack((begin, begin + children))])
            bits, shared, groups = all_one & kept, kept, groups[begin]
        self.levels = levels[::-1]
        self.prints = prints
        new = np.ones(len(buckets), dtype=bool)
        new[1:] = buckets[1:] != buckets[:-1]
        self.tree = np.cumsum(new) - 1  # each bucket ends in one root, in order

    def search(self, low: int, high: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (i, j, differences), i in [low, high), j < i of the same bucket, within the radius."""
        who = np.arange(low, high)
        node = self.tree[who]
        differ = np.zeros(len(who), dtype=np.uint8)
        for depth, (bits, own, children) in enumerate(self.levels):
            differ = differ + np.bitwise_count((self.prints[who] ^ bits[node]) & own[node])
            near = differ <= radius
            who, node, differ = who[near], node[near], differ[near]
            if children is None:
                break
            begin, end = children[0][node], children[1][node]
            count = end - begin
            at = np.cumsum(count) - count
            node = np.repeat(begin - at, count) + np.arange(count.sum())
            who, differ = np.repeat(who, count), np.repeat(differ, count)
            if depth == len(self.levels) - 2:
                before = node < who
                who, node, differ = who[before], node[before], differ[before]
        return who, node, differ


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def link(buckets: np.ndarray, prints: np.ndarray, radius: int, same: Callable[[int, int], bool] | None = None, budget: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, index) that join what is within the radius in each bucket, and what
    `same` then accepts. Input sorted by (bucket, Gray rank). Pairs already joined in the
    bucket are not looked at again, so a dense bucket gives one link for each of its rows."""
    index = GrayIndex(buckets, prints)
    _, tree_size = np.unique(index.tree, return_counts=True)
    cost = np.cumsum(tree_size[index.tree])
    parent, low, out = np.arange(len(prints)), 0, []
    while low < len(prints):
        done = cost[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(cost, done + budget, "right")))
        i, j, _ = index.search(low, high, radius)
        low = high
        roots = parent.copy()
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up
        apart = roots[i] != roots[j]
        if not apart.any():
            continue
        own = roots.tolist()
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            x, y = _find(own, a), _find(own, b)
            if x != y and (same is None or same(a, b)):
                own[max(x, y)] = min(x, y)
                out.append((a, b))
        parent = np.array(own)
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _whole_buckets(batches: Iterator[pa.RecordBatch], rows: int, most: int = 1 << 30) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches sorted by the column `bucket`, of about `rows` rows
    or `most` bytes."""
    kept: list[pa.RecordBatch] = []
    size = held = 0
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        own = b.column("bucket").to_numpy()
        # what is kept ends with the bucket `last`; only the new batch is searched for its end
        cut = int(np.searchsorted(own, last, "right")) if last is not None and own[0] == last else 0
        if kept and cut < len(own) and (size + cut >= rows or held >= most):
            yield pa.Table.from_batches([*kept, b.slice(0, cut)] if cut else kept)
            kept, size, held, b = [], 0, 0, b.slice(cut)
        kept.append(b)
        size += b.num_rows
        held += b.nbytes
        last = own[-1]
    if kept:
        yield pa.Table.from_batches(kept)


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buckets, prints = table["bucket"].to_numpy(), table["fingerprint"].to_numpy().view(U)
    order = np.lexsort((gray_rank(prints), buckets))
    return order, buckets[order], prints[order]


def _block(value: Column, low: int, high: int) -> Column:
    """Bits low to high - 1 of a long, at its lowest place."""
    return F.shiftrightunsigned(F.shiftleft(value, 64 - high), 64 - (high - low))


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [bits * k // parts for k in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def near_prints(prints: DataFrame, radius: int = 3, split: int = 20_000, rows: int = 200_000) -> DataFrame:
    """Links a, b between different fingerprints that join all within `radius` bits of each other.

    Of radius + 1 blocks of bits, two such fingerprints agree in one at least, so each
    fingerprint goes to one bucket for each of its blocks. The bits beside the block differ
    in `radius` places at most too, so a bucket of more than `split` fingerprints is dealt
    again, by radius + 1 blocks of those bits; no link is lost. Fingerprints are
    different, so copies, however many, don't fill a bucket. `prints` has the one column
    `fingerprint` (long) without repeats or nulls.
    """
    x, keys, again = F.col("fingerprint"), [], []
    for k, (low, high) in enumerate(_blocks(64, radius + 1)):
        keys.append(F.xxhash64(F.lit(k), _block(x, low, high)))
        rest = F.shiftleft(_block(x, high, 64), low) if high < 64 else F.lit(0).cast("long")
        rest = rest.bitwiseOR(_block(x, 0, low)) if low else rest
        again.append(F.array(*[F.xxhash64(F.lit(k), _block(x, low, high), F.lit(j), _block(rest, a, b)) for j, (a, b) in enumerate(_blocks(64 - (high - low), radius + 1))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches, rows):
            _, buckets, own = _sorted(table)
            i, j = link(buckets, own, radius)
            yield pa.RecordBatch.from_arrays([pa.array(own[i].view(np.int64)), pa.array(own[j].view(np.int64))], names=["a", "b"])

    dealt = prints.select("fingerprint", F.posexplode(F.array(*keys)).alias("k", "bucket"))
    large = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("bucket", F.lit(True).alias("large"))
    to = F.when(F.col("large"), F.element_at(F.array(*again), F.col("k") + 1)).otherwise(F.array("bucket"))
    fine = dealt.join(large, "bucket", "left").select("fingerprint", F.explode(to).alias("bucket"))
    return fine.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def groups(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (long) and component_id (smallest doc_id reachable) of each row.

    Rows link when their fingerprints differ in `radius` bits or fewer; equal fingerprints
    are one node. A component whose doc_ids are all null has a null component_id; repeated
    rows repeat in the result; an empty table gives no rows. Very long texts are read as a whole; columns other than
    doc_id and text are left out, whatever their names.
    """
    prints = checkpoint(fingerprints(documents, shingle))
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    star = components(near_prints(nodes.select("fingerprint"), radius))
    nodes = nodes.join(star.select(F.col("u").alias("fingerprint"), F.col("v").alias("root")), "fingerprint", "left")
    nodes = checkpoint(nodes.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))
    found = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(found, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles and links of up to three bits over all documents."""
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of hashes."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def _views(table: pa.Table, name: str) -> list[np.ndarray]:
    """The hashes of each row of a binary column, where they lie."""
    out: list[np.ndarray] = []
    for c in table[name].chunks:
        edge = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].tolist()
        raw = memoryview(c.buffers()[2] or b"")
        out += [np.frombuffer(raw[a:b], np.uint32) for a, b in zip(edge, edge[1:], strict=False)]
    return out


def _sets(documents: DataFrame, shingle: int, keys: int, carry: list[str], block_bytes: int = 1 << 20) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = T.byte_list(b.column("text"))
            prints, sizes, whole, smallest, sets = [], [], [], [], []
            for i, j in T.spans(texts, block_bytes):
                hashes, n = shingle_hashes(texts[i:j], shingle, 42)
                edge = np.concatenate(([0], np.cumsum(n))).tolist()
                mixed = (T.mix(hashes) >> U(32)).astype(np.uint32)
                spread, first = [], len(sizes)
                for x, y in zip(edge, edge[1:], strict=False):
                    own = np.unique(mixed[x:y])
                    sizes.append(len(own))
                    spread.append(T.mix(own.astype(U) + U(1)))
                    whole.append(int(spread[-1].sum(dtype=U).view(np.int64)) if len(own) else 0)
                    smallest.append(own[: 2 * keys].astype(np.int64).tolist())
                    sets.append(own.tobytes())
                if spread:
                    prints.append(majority(np.concatenate(spread), np.array(sizes[first:], dtype=np.int64)))
            fp = np.concatenate(prints).view(np.int64) if prints else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_ident"), pa.array(fp), pa.array(sizes, pa.int64()), pa.array(whole, pa.int64()), pa.array(smallest, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["_ident", "fingerprint", "n", "whole", "keys", "own"])

    T.small_batches(documents)
    doc = F.col("doc_id").cast("long")
    ident = F.struct(doc.isNull().alias("none"), doc.alias("doc_id"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    rows = documents.select(ident.alias("_ident"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["_ident"]
    return rows.mapInArrow(T.lean(run), f"_ident {kind}, fingerprint long, n long, whole long, keys array<long>, own binary")


def _cells(bucket: list[str], kind: int, split: int) -> Column:
    """The buckets that a node of such a bucket goes to. A bucket of weight over `split` is
    parted by a hash of node into parts of half of `split`, and any two parts meet in one."""
    part = F.pmod(F.xxhash64("node", *bucket), F.col("parts"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: o != part)
    pairs = F.transform(other, lambda o: F.xxhash64(F.lit(kind + 1), *bucket, F.least(o, part), F.greatest(o, part)))
    return F.when(F.col("weight") > split, pairs).otherwise(F.array(F.xxhash64(F.lit(kind), *bucket)))


def _deal(prints: DataFrame, keys: int, split: int) -> DataFrame:
    """node and bucket, so that nodes which share one of their `keys` smallest hashes meet in a bucket,
    and no bucket has much more than the weight `split` (a node weighs one, and one more for each
    thousand shingles).

    The nodes of a large bucket are dealt again by a second shared hash, out of twice as many
    smallest ones: similar sets share many, others few. Where that would move more rows than
    dealing the bucket in parts of which any two meet, as for thousands of texts that are all
    near to each other, the bucket is dealt in such parts. Neither drops a node.
    """

    def weigh(rows: DataFrame, *by: str) -> DataFrame:
        met = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight")).where("n > 1")
        return met.withColumn("parts", F.least(F.ceil(2 * F.col("weight") / split), F.col("n")))

    moved = F.sum(F.col("weight") * F.when(F.col("weight") > split, F.col("parts") - 1).otherwise(1))
    pairs = prints.select("node", (1 + F.floor(F.col("n") / 1000)).alias("w"), F.explode(F.slice("keys", 1, keys)).alias("x")).distinct()
    met = checkpoint(pairs.join(weigh(pairs, "x"), "x"))
    large = met.where(F.col("weight") > split)
    if large.isEmpty():
        return met.select("node", F.xxhash64(F.lit(0), "x").alias("bucket"))
    others = prints.select("node", "keys").distinct()
    seconds = large.select("node", "w", "x").join(others, "node").select("node", "w", "x", F.explode("keys").alias("y")).where("x != y")
    second = checkpoint(weigh(seconds, "x", "y"))
    cost = large.select("x", "weight", "parts").distinct().groupBy("x").agg(moved.alias("plain"))
    dense = second.groupBy("x").agg(moved.alias("finer")).join(cost, "x").where("finer >= plain").select("x")
    fine = seconds.join(dense, "x", "left_anti").join(second, ["x", "y"])
    parts = [
        met.where(F.col("weight") <= split).select("node", F.array(F.xxhash64(F.lit(0), "x")).alias("to")),
        large.join(dense, "x", "left_semi").select("node", _cells(["x"], 1, split).alias("to")),
        fine.select("node", _cells(["x", "y"], 3, split).alias("to")),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select("node", F.explode("to").alias("bucket"))


def near_duplicates(documents: DataFrame, carry: list[str] | None = None, shingle: int = 5, similarity: float = 0.8, radius: int = 24, keys: int = 6, split: int = 2_000, rows: int = 8_000, set_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, the columns `carry`, component_id (smallest doc_id reachable) and is_first of each row,
    by shingle sets. is_first holds for the rows with the smallest doc_id and then the smallest
    carried values of a group; a null doc_id stands behind all others.

    Rows with equal shingle sets are one node. Different nodes are compared when they share
    one of their `keys` smallest shingle hashes and the Gray-order index finds their
    fingerprints within `radius` bits; they link when the similarity of their
    whole sets, of any size, is `similarity` or more. Buckets of more than `split` nodes are
    dealt over many tasks (see `_deal`). Fingerprints
    are of the sets: repeated shingles count once. README has what keys and radius lose. Texts with
    fewer words than `shingle` are one shingle; null and wordless texts are equal to each
    other. A very long text is read as a whole; its set takes four bytes a shingle. A null doc_id
    gets a null component_id when its group has no other. Other columns are left out, repeated
    rows repeat in the result, and an empty table gives no rows.
    """
    carry = carry or []
    prints = checkpoint(_sets(documents, shingle, keys, carry).withColumn("node", F.xxhash64("n", "whole")))
    # sets travel only to buckets where they meet another
    wanted = _deal(prints, keys, split).groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    nodes = prints.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.first("n").alias("n"), F.first("own").alias("own"))
    least = prints.groupBy("node").agg(F.min("_ident").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches, rows, set_bytes):
            order, buckets, own = _sorted(table)
            ids, sizes = table["node"].to_numpy()[order], table["n"].to_numpy()[order]
            sets, at = _views(table, "own"), order.tolist()

            def same(a: int, b: int, sets=sets, at=at, sizes=sizes) -> bool:
                n, m = int(sizes[a]), int(sizes[b])
                return min(n, m) >= similarity * max(n, m) and _jaccard(sets[at[a]], sets[at[b]]) >= similarity

            i, j = link(buckets, own, radius, same)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])
            del table, sets, same
            T.tidy()

    dealt = nodes.join(wanted, "node").select("node", "fingerprint", "n", "own", F.explode("buckets").alias("bucket"))
    star = components(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long"))
    roots = least.join(star.select(F.col("u").alias("node"), "v"), "node", "left").select("node", "least", F.coalesce("v", "node").alias("root"))
    roots = checkpoint(roots)
    found = roots.groupBy("root").agg(F.min("least").alias("first"))
    out = prints.select("_ident", "node").join(roots.join(found, "root").select("node", "first"), "node")
    return out.select("_ident.doc_id", *[F.col("_ident.carry")[c].alias(c) for c in carry], F.col("first.doc_id").alias("component_id"), F.col("_ident").eqNullSafe(F.col("first")).alias("is_first"))

"""Benchmark decontamination with a generalised suffix automaton over item words.

Every item's words feed one suffix automaton whose states carry the items they
occur in. A document's words are streamed through it while the length of the
longest match is tracked. A window is `n` consecutive words of an item, or a whole
shorter item; words inside a window's occurrence are hits.

Only runs in which every pair of neighbours is a pair of neighbours of some item can
hold a window, so vectorised hash lookups leave few words for the automaton, which then
takes words by their bytes, never by a hash. Documents are never shuffled. Items are read in
parts of about `max_bytes` of text. Each part makes one automaton, which is built on the driver,
broadcast, and given up before the next part is read: neither grows with the benchmark. Each
part is one narrow pass over the documents; between passes a checkpoint cuts the chain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint
from . import text as T

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())  # lowers A-Z alone


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty match."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.n = n
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [i for i, _ in items]
        sequences = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words in items]
        for s in sequences:
            last = 0
            for w in s:
                last = self._extend(last, w)
        self._mark(sequences)
        self._index(sequences)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._clone(last, w, q)
        cur = self._state(length[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _mark(self, sequences: list[list[int]]) -> None:
        """top: for a state of n words or more, that of its last n; holds: items by that state;
        ends: short items that end in a state, by length; near: the nearest state on the way to
        the root with such an end."""
        n, link, length = self.n, self.link, self.length
        self.ends: list[dict[int, list[int]] | None] = [None] * len(link)
        self.top, self.near = [0] * len(link), [0] * len(link)
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for at in order:
            if length[at] >= n:
                self.top[at] = at if length[link[at]] < n else self.top[link[at]]
        self.holds: dict[int, set[int]] = {}
        for k, s in enumerate(sequences):
            state = 0
            for i, w in enumerate(s):
                state = self.next[state][w]
                if i + 1 >= n:
                    self.holds.setdefault(self.top[state], set()).add(k)
            if 0 < len(s) < n:
                if self.ends[state] is None:
                    self.ends[state] = {}
                self.ends[state].setdefault(len(s), []).append(k)
        for at in order:
            self.near[at] = at if self.ends[at] else self.near[link[at]]
        short = [len(s) for s in sequences if 0 < len(s) < n]
        self.least = min([n, *short])

    def _index(self, sequences: list[list[int]]) -> None:
        """Words by hash, for the choice of runs alone: words of one hash count as one there."""
        words = list(self.vocab)
        hashed = T.Words([b" ".join(words)], T.ALNUM).hashes() if words else np.empty(0, T.U)
        self.word_hash, number = np.unique(hashed, return_inverse=True)
        number = number.ravel().tolist()
        pairs = {number[a] * len(self.word_hash) + number[b] for s in sequences for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's hash, -1 where no item has it."""
        if not len(self.word_hash):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.word_hash, hashes), len(self.word_hash) - 1)
        return np.where(self.word_hash[at] == hashes, at, -1)

    def runs(self, ids: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the word runs that may hold a window."""
        n = len(ids)
        if not n:
            return ids, ids
        linked = np.zeros(n + 1, dtype=bool)  # linked[i]: words i-1 and i are neighbours in an item
        near = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & (text_of[1:] == text_of[:-1]))
        if len(near) and len(self.pairs):
            key = ids[near] * len(self.word_hash) + ids[near + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            linked[near[self.pairs[at] == key] + 1] = True
        start = np.flatnonzero((ids >= 0) & ~linked[:-1])
        end = np.flatnonzero((ids >= 0) & ~linked[1:]) + 1
        long = end - start >= self.least
        return start[long], end[long]

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(end, window length, state) of each window that occurs; owners() has its items."""
        nxt, link, length, n, vocab = self.next, self.link, self.length, self.n, self.vocab
        state, matched = 0, 0
        for i, word in enumerate(words):
            w = vocab.get(word, -1)
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w not in nxt[state]:
                continue
            state, matched = nxt[state][w], matched + 1
            if matched >= n and self.top[state]:
                yield i + 1, n, self.top[state]
            at = self.near[state]
            while at:
                for size in self.ends[at]:
                    if size <= matched:
                        yield i + 1, size, at
                at = self.near[link[at]]

    def owners(self, size: int, state: int) -> set[int] | list[int]:
        return self.holds[state] if size == self.n else self.ends[state][size]


def automata(items: DataFrame, n: int, max_bytes: int) -> Iterator[Automaton]:
    """One automaton for each `max_bytes` of item text, one after another; an empty one if there is no word at all, so
    that documents are scanned in any case. A longer item is cut into
    pieces that share n - 1 words, so that each of its windows is in one of them."""
    part: list[tuple[str | None, list[bytes]]] = []
    size, made = 0, False
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words, at = item_words(r["text"]), 0
        while at < len(words) and (at == 0 or len(words) - at >= n):
            end, own = at, 0
            while end < len(words) and (end - at < n or own < max_bytes):
                own += len(words[end]) + 1
                end += 1
            if part and size + own > max_bytes:
                yield Automaton(part, n)
                part, size, made = [], 0, True
            part.append((r["item_id"], words[at:end]))
            size += own
            at = end - n + 1 if end < len(words) else end
    if part or not made:
        yield Automaton(part, n)


def _scan(auto: Automaton, texts: list[bytes], limit: int) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """For each text its number of words, its hit words' indexes and its items."""
    for low, high in T.spans(texts, limit):
        words = T.Words(texts[low:high], T.ALNUM, lower=True)
        ids, owner = auto.known(words.hashes()), words.text_of()
        hit: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[tuple[int, int]]] = {}
        for a, b in zip(*(x.tolist() for x in auto.runs(ids, owner)), strict=True):
            doc = int(owner[a])
            base = a - int(words.first[doc])
            own = [words.data[x:y].tobytes() for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
            for end, size, state in auto.stream(own):
                hit.setdefault(doc, []).append((base + end - size, base + end))
                found.setdefault(doc, set()).add((size, state))
        for d, count in enumerate(words.counts.tolist()):
            if d not in hit:
                yield count, np.empty(0, np.int64), set()
                continue
            edge = np.zeros(count + 1, dtype=np.int64)
            for s, e in hit[d]:
                edge[s] += 1
                edge[e] -= 1
            yield count, np.flatnonzero(np.cumsum(edge)[:-1] > 0), {auto.ids[k] for x in found[d] for k in auto.owners(*x)}


def hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = 2 << 20, block_bytes: int = 1 << 20) -> DataFrame:
    """`documents` with n_words (long), hit_words (array of word indexes) and hit_items
    (array of item ids as strings, sorted).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null or
    wordless text has zero words and no hits. Items without words have no windows, so an empty or wordless benchmark hits
    nothing; the windows of an item without id count, but it is not named. Repeated items count under each id. A very long text is read as a whole, in time linear
    in its length. Columns of the input with the added names are replaced; repeated rows give
    repeated rows; an empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    T.small_batches(documents)
    out = documents.drop("n_words", "hit_words", "hit_items")
    out = out.withColumns({"n_words": F.lit(None).cast("long"), "hit_words": F.lit(None).cast("array<int>"), "hit_items": F.lit(None).cast("array<string>")})
    shared = None
    for auto in automata(benchmark, n, max_bytes):
        if shared is not None:
            out = checkpoint(out)
            shared.destroy()
        shared = documents.sparkSession.sparkContext.broadcast(auto)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = T.byte_list(b.column("text"))
                counts, marked, items = [], b.column("hit_words").to_pylist(), b.column("hit_items").to_pylist()
                for i, (count, own, names) in enumerate(_scan(shared.value, texts, block_bytes)):
                    counts.append(count)
                    marked[i] = np.union1d(own, marked[i]).astype(np.int32) if marked[i] else own.astype(np.int32)
                    items[i] = sorted(names.union(items[i] or ()), key=lambda x: (x is None, x))
                columns = dict(zip(b.schema.names, b.columns, strict=True))
                columns |= {"n_words": pa.array(counts, pa.int64()), "hit_words": pa.array(marked, pa.list_(pa.int32())), "hit_items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        out = out.mapInArrow(T.lean(scan), out.schema)
    return out


def remove_hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_coverage: float = 0.5, **limits) -> DataFrame:
    """`documents`, with the same columns, without their hit words.

    A document with more than `max_coverage` of its words hit goes as a whole; in any
    other, hit words and the separators after them are cut out of the text. Documents
    without hits come back unchanged, null texts included, and so do all with a benchmark that is empty or has no words.
    A very long text is read as a whole; repeated rows give repeated rows; an empty table gives no rows. Columns that
    share names with those of hits() keep their values.
    """
    columns = documents.columns
    rest = F.struct(F.lit(0).alias("text"), *[F.col(c) for c in columns if c != "text"]).alias("_row")
    marked = hits(documents.select("text", rest), benchmark, n, **limits)
    kept = marked.where((F.size("hit_words") == 0) | (F.size("hit_words") <= max_coverage * F.col("n_words")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column("text").to_pylist()
            for i, own in enumerate(b.column("hit_words").to_pylist()):
                if own:
                    raw = out[i].encode()
                    words = T.Words([raw], T.ALNUM, lower=True)
                    until = np.append(words.start[1:], len(raw))
                    edge = np.zeros(len(raw) + 1, dtype=np.int64)
                    edge[words.start[own]] += 1
                    np.add.at(edge, until[own], -1)
                    out[i] = np.frombuffer(raw, np.uint8)[np.cumsum(edge)[:-1] == 0].tobytes().decode()
            columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = kept.select("text", "_row", "hit_words")
    return kept.mapInArrow(T.lean(cut), kept.schema).select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns])


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten item words over all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = hits(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, ord, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, row_number() OVER () AS ord FROM documents)),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dwin AS (
  SELECT ord, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT ord, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
m AS (SELECT d.ord, d.i, d.k, b.item_id FROM dwin d JOIN iw b ON d.k = b.k AND d.win = b.win),
h AS (SELECT ord, count(DISTINCT p) AS n_hit FROM (SELECT ord, unnest(range(i, i + k)) AS p FROM m) GROUP BY ord),
it AS (SELECT ord, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT ord, item_id FROM m) GROUP BY ord)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.ord = h.ord LEFT JOIN it ON dw.ord = it.ord
"""

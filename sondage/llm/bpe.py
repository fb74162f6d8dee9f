"""BPE encoding and decoding of whole texts with a published word-end vocabulary.

Each piece's parts and the ranks of its adjacent pairs stand in contiguous arrays. The
smallest rank is searched by a scan, the boundary there is deleted, and the ranks beside
it are refreshed, until no adjacent pair can merge. The arrays of many pieces of one
length are rows of a matrix, so a scan serves them all. Pieces of more than `SHORT`
parts use a heap of ranks with linked parts, which gives the same merges.

Results for strings between white space are kept in a bounded store for each Python
worker, which changes no result. The vocabulary (a few MB, fixed by its file) is read on
the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

SHORT = 96
NONE = np.int32(2**31 - 1)
#: Unicode white space; Python's own class has U+001C to U+001F besides.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Letters and digits of Unicode 17 that are neither for the library, whose classes are
#: those of Unicode 16, by their first and last code points.
_LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Capitals that Python's tables do not know, as first, last and the small letter of the first.
_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_SMALL = {c: to + c - a for a, b, to in _CAPITALS for c in range(a, b + 1)} | {ord("Σ"): "σ"}  # capital sigma: no final form
#: Marks (and U+11930, which would compose) of Python's Unicode tables that are unknown to the library's
#: normalisation, whose tables are older: it neither moves nor composes them, by their first and last code points.
_UNMOVED = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
_FIXED = regex.compile(f"([{''.join(f'{chr(a)}-{chr(b)}' for a, b in _UNMOVED)}]+)")
_NEITHER = "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER)
_L, _N = (rf"[\p{{{k}}}--[{_NEITHER}]]" for k in "LN")
_PIECE = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|[^{_SPACE}{_L}{_N}]+")
_SPLIT = regex.compile(rf"[^{_SPACE}]+")


def nfc(s: str) -> str:
    """NFC as the library has it: what stands between marks that it doesn't know is composed on its own."""
    if _FIXED.search(s):
        return "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(_FIXED.split(s)))
    return unicodedata.normalize("NFC", s)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file of the kind read here."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a BPE vocabulary with word ends </w> is needed")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = vocab | self.special
        self.tokens = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.tokens[i] = token.encode()
        marks = byte_characters()
        self.inner = np.array([vocab[c] for c in marks], dtype=np.int32)
        self.final = np.array([vocab[f"{c}</w>"] for c in marks], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a] << 16) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._table()

    def _table(self) -> None:
        """Open addressing of the pairs, for lookups of whole arrays."""
        self.bits = max(10, (8 * len(self.merges)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks = np.full(size, NONE, dtype=np.int32)
        self.made = np.zeros(size, dtype=np.int32)
        for key, (rank, made) in self.merges.items():
            at = int(self._slot(np.array([key], dtype=np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.ranks[at], self.made[at] = key, rank, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(T.U) * T.U(0x9E3779B97F4A7C15)) >> T.U(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs; a pair that never merges gets a slot of rank NONE."""
        shape, key = left.shape, ((left.astype(np.int64) << 16) | right).ravel()
        at = self._slot(key)
        other = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[other]]
            other = other[(seen != key[other]) & (seen >= 0)]
        return at.reshape(shape)

    def encode_equal(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of pieces that all have the same number of bytes, at most SHORT: indexes and, as rows
        of a matrix, ids of those that end with the same number of parts."""
        length = len(pieces[0])
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(len(pieces), length)
        parts = self.inner[raw]
        parts[:, -1] = self.final[raw[:, -1]]
        rows = np.arange(len(pieces))
        slots = self.look(parts[:, :-1], parts[:, 1:])
        ranks = self.ranks[slots]
        while len(rows):
            if not ranks.shape[1]:
                yield rows, parts
                return
            at = ranks.argmin(axis=1)
            done = ranks[np.arange(len(rows)), at] == NONE
            if done.any():
                yield rows[done], parts[done]
                rows, parts, slots, ranks, at = rows[~done], parts[~done], slots[~done], ranks[~done], at[~done]
                if not len(rows):
                    return
            n, width = np.arange(len(rows)), parts.shape[1]
            made = self.made[slots[n, at]]
            columns = np.arange(width - 1)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            parts[n, at] = made
            columns = np.arange(width - 2)
            moved = columns + (columns >= at[:, None])
            slots, ranks = np.take_along_axis(slots, moved, axis=1), np.take_along_axis(ranks, moved, axis=1)
            for side, has in ((at - 1, at > 0), (at, at < width - 2)):
                r, c = n[has], side[has]
                new = self.look(parts[r, c], parts[r, c + 1])
                slots[r, c] = new
                ranks[r, c] = self.ranks[new]

    def encode_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece by a heap of ranks; leftmost first among equal ranks."""
        parts = [*self.inner[np.frombuffer(piece[:-1], np.uint8)].tolist(), int(self.final[piece[-1]])]
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges, heap = self.merges, []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := merges.get((parts[i] << 16) | parts[j])):
                heapq.heappush(heap, (found[0], i, parts[i], parts[j], found[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([p for p in parts if p >= 0], dtype=np.int32)

    def encode_pieces(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and where each begins (one more at the end). An
        int stands for itself."""
        by_size: dict[int, tuple[list[int], list[bytes]]] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, p in enumerate(pieces):
            if isinstance(p, int):
                found.append((np.array([i]), np.array([[p]], dtype=np.int32)))
                continue
            raw = p.encode()
            if len(raw) > SHORT:
                found.append((np.array([i]), self.encode_long(raw)[None]))
            else:
                own, raws = by_size.setdefault(len(raw), ([], []))
                own.append(i)
                raws.append(raw)
        for own, raws in by_size.values():
            own = np.array(own)
            found += [(own[rows], ids) for rows, ids in self.encode_equal(raws)]
        at = np.zeros(len(pieces) + 1, dtype=np.int64)
        for rows, ids in found:
            at[rows + 1] = ids.shape[1]
        at = np.cumsum(at)
        out = np.empty(at[-1], dtype=np.int32)
        for rows, ids in found:
            out[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, at

    def pieces(self, chunk: str) -> list[str | int]:
        """Pieces of a string without white space; special tokens as ids."""
        if self.splits and "<|" in chunk:
            out, last = [], 0
            for m in self.splits.finditer(chunk):
                out += [*self._plain(chunk[last : m.start()]), self.special[m.group()]]
                last = m.end()
            return out + self._plain(chunk[last:])
        return self._plain(chunk)

    @staticmethod
    def _plain(s: str) -> list[str]:
        if not s.isascii():
            s = nfc(s).translate(_SMALL)
        s = s.lower()
        if s.isalpha():
            return [s]
        if s[-1:] in (".", ",") and s[:-1].isalpha():
            return [s[:-1], s[-1]]
        return _PIECE.findall(s)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `flat`, one after another, and where each begins (one more at the end)."""
    at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    return flat[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


class Encoder:
    """Encodes blocks of texts; keeps the ids of at most `keep` strings between white space."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 150_000):
        self.v, self.keep = vocabulary, keep
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.at, self.flat = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32)

    def _learn(self, chunks: list[str]) -> None:
        split = list(map(self.v.pieces, chunks))
        number: dict[str | int, int] = {}
        which = np.array([number.setdefault(p, len(number)) for p in chain.from_iterable(split)], dtype=np.int64)
        ids, at = self.v.encode_pieces(list(number))
        ids, at = _gather(ids, at[which], at[which + 1] - at[which])
        edge = np.zeros(len(chunks) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, split), np.int64, len(split)), out=edge[1:])
        self.index.update(zip(chunks, range(len(self.at) - 1, len(self.at) - 1 + len(chunks)), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + at[edge[1:]]])
        self.flat = np.concatenate([self.flat, ids])

    def _shrink(self, used: set[str]) -> None:
        """Forget all strings but those in `used`."""
        kept = [(c, i) for c, i in self.index.items() if c in used]
        which = np.array([i for _, i in kept], dtype=np.int64)
        self.flat, self.at = _gather(self.flat, self.at[which], self.at[which + 1] - self.at[which])
        self.index = {c: k for k, (c, _) in enumerate(kept)}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        split = [t.split() if not any(c in t for c in "\x1c\x1d\x1e\x1f") else _SPLIT.findall(t) for t in texts]
        chunks = list(chain.from_iterable(split))
        if len(self.index) > self.keep:
            self._shrink(set(chunks))
        got = list(map(self.index.get, chunks))
        if None in got:
            self._learn(list({c for c, i in zip(chunks, got, strict=True) if i is None}))
            got = list(map(self.index.get, chunks))
        which = np.array(got, dtype=np.int64)
        ids, at = _gather(self.flat, self.at[which], self.at[which + 1] - self.at[which])
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, split), np.int64, len(split)), out=first[1:])
        return ids, np.diff(at[first])


class Decoder:
    """Texts of ids: their tokens joined by one space, as the library decodes with a vocabulary
    file that names no decoder."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens))
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.frombuffer(b"".join(t + b" " for t in tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """A text for each stretch of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is outside the vocabulary")
        pieces = [ids[i : i + 65536] for i in range(0, len(ids), 65536)]  # gathering takes many bytes for each of a text
        raw = b"".join(_gather(self.flat, self.begin[p], self.size[p])[0].tobytes() for p in pieces)
        at = np.concatenate(([0], np.cumsum(self.size[ids])))
        edge = at[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return pa.array([raw[x : max(x, y - 1)] for x, y in zip(edge, edge[1:], strict=False)], pa.binary()).cast(pa.string())


_KEPT: dict[str, object] = {}


def _worker(shared) -> tuple[Encoder, Decoder]:
    """This worker's encoder and decoder of a broadcast vocabulary."""
    if _KEPT.get("vocabulary") is not shared.value:
        _KEPT.update(vocabulary=shared.value, encoder=Encoder(shared.value), decoder=Decoder(shared.value.tokens))
    return _KEPT["encoder"], _KEPT["decoder"]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def encode(documents: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None, block_bytes: int = 1 << 20) -> DataFrame:
    """`documents` with the array<int> column `ids` of the token ids of `text`, and, if `decoded`
    names one, a string column of the text decoded from these ids.

    The ids are those of the tokenizers library with add_special_tokens=False, without
    truncation and padding. Null and empty texts have no ids. Other columns pass through;
    columns that already have the new names are replaced. Rows are independent: repeated
    rows give equal results and an empty table gives no rows. A very long text is encoded as a whole; one without white
    space is one piece for the heap of merges, in time n log n.
    """
    T.small_batches(documents)
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    new = {ids: F.lit(None).cast("array<int>")} | ({decoded: F.lit(None).cast("string")} if decoded else {})
    out = documents.drop(*new).withColumns(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(shared)
        for b in batches:
            values, counts, texts = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [t or "" for t in b.column(text).to_pylist()]
            low, size = 0, 0
            for i, t in enumerate([*texts, None]):
                if t is None or size > block_bytes:
                    own = encoder.encode(texts[low:i])
                    values.append(own[0])
                    counts.append(own[1])
                    low, size = i, 0
                size += len(t or "")
            found, n = np.concatenate(values), np.concatenate(counts)
            yield _with(b, {ids: _lists(found, n, pa.int32())} | ({decoded: decoder.decode(found, n)} if decoded else {}))

    return out.mapInArrow(T.lean(run), out.schema)


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`tokens` with the string column `text` decoded from the column `ids`.

    As the tokenizers library's decode(ids, skip_special_tokens=False). No ids and null give an
    empty text; an id outside the vocabulary is an error. A column that has the new name is replaced, others pass
    through. Very long lists are decoded as a whole; repeated rows give equal texts, and an empty table gives no rows.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    out = tokens.drop(text).withColumn(text, F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _worker(shared)
        for b in batches:
            column = b.column(ids)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield _with(b, {text: decoder.decode(column.flatten().to_numpy(zero_copy_only=False), counts)})

    return out.mapInArrow(T.lean(run), out.schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, then decoded from its ids."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = encode(documents, decoded="decoded")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

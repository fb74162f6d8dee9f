"""Byte-level, vectorised word splitting and hashing over blocks of texts.

A block is many UTF-8 texts joined by a line feed, so every word is followed by a
separator and no word crosses texts. All word classes used here are unions of
single bytes (bytes from 0x80 up belong to whole characters), so splitting bytes
splits characters correctly.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

U = np.uint64


def _table(excluded: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    for low, high in excluded:
        inside[low : high + 1] = False
    return inside


#: [^\x20\x09-\x0D]+
NOT_SPACE = _table([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: ASCII digits, a-z and all beyond ASCII
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, base, dtype=U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_SEQ = (Powers(0x2545F4914F6CDD1D), Powers(0x9E3779B97F4A7C15))


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def spans(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about `limit` bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _TRIM = None


def tidy() -> None:
    """Give free memory back to the system: workers live on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def small_batches(frame: DataFrame, rows: int = 1000) -> None:
    """Let Spark send texts to Python in batches of `rows`, unless the session names another
    number than Spark's own 10000: whole texts make large batches, in the JVM and here."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", frame.sparkSession.conf
    if conf.get(name) == "10000":
        conf.set(name, rows)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run, batch_bytes: int = 4 << 20) -> Run:
    """`run` over slices of the batches of about `batch_bytes`, memory given back after each."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, int(b.num_rows * batch_bytes / max(1, b.nbytes)))
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
                tidy()
            del b

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches))
        tidy()

    return small


class Words:
    """Words of a block of texts.

    data: the block's bytes, folded; start, end: of each word; first: index of each
    text's first word, with the number of words at its end.
    """

    def __init__(self, texts: list[bytes], inside: np.ndarray, lower: bool = False):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.data = LOWER[raw] if lower else raw
        is_word = inside[self.data]
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        if is_word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.size = self.end - self.start
        begins = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=begins[1:])
        self.first = np.searchsorted(self.start, begins)
        self.counts = np.diff(self.first)
        self.n = len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """XXH64 of each word."""
        return xxh64(self.data, self.start, self.size, seed)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space after each, and where each begins (one more at the end)."""
        at = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(self.size + 1, out=at[1:])
        take = np.repeat(self.start - at[:-1], self.size + 1) + np.arange(at[-1])
        out = self.data[take]
        out[at[1:] - 1] = 0x20
        return out, at


def sequence_prefix(words: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = _SEQ[which].upto(len(words) + 1)
    total = np.empty(len(words) + 1, dtype=U)
    total[0] = 0
    np.cumsum(words * up[:-1], out=total[1:])
    return total


def sequence_hash(prefix: np.ndarray, start: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the `length` word hashes from each start on."""
    _, down = _SEQ[which].upto(len(prefix))
    return mix((prefix[start + length] - prefix[start]) * down[start])


_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64_equal(data: np.ndarray, u8: np.ndarray, u4: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    done = 0
    with np.errstate(over="ignore"):
        if length >= 32:
            s = U(seed)
            v = [np.full(len(at), x, dtype=U) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while done + 32 <= length:
                v = [_round(v[k], u8[at + (done + 8 * k)]) for k in range(4)]
                done += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros(len(at), dtype=U), x)) * _P1 + _P4
        else:
            h = np.full(len(at), U(seed) + _P5, dtype=U)
        h = h + U(length)
        while done + 8 <= length:
            h = _rotl(h ^ (_rotl(u8[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
            done += 8
        if done + 4 <= length:
            h = _rotl(h ^ (u4[at + done].astype(U) * _P1), 23) * _P2 + _P3
            done += 4
        while done < length:
            h = _rotl(h ^ (data[at + done].astype(U) * _P5), 11) * _P1
            done += 1
        h = (h ^ (h >> U(33))) * _P2
        h = (h ^ (h >> U(29))) * _P3
        return h ^ (h >> U(32))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte ranges of `data` at once, dealt by length."""
    out = np.empty(len(start), dtype=U)
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    u8 = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    u4 = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    order = np.argsort(size.astype(np.uint16) if size.max() < 65536 else size, kind="stable")
    sizes = size[order]
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    for low, high in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(order)])), strict=True):
        own, length = order[low:high], int(sizes[low])
        if high - low < 24 or length > 512:
            view = memoryview(data)
            out[own] = [xxhash.xxh64_intdigest(view[a : a + length], seed) for a in start[own].tolist()]
        else:
            out[own] = _xxh64_equal(padded, u8, u4, start[own], length, seed)
    return out

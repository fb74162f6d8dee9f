"""Language identification by nearest centroid.

Texts become vectors of hashed letter n-grams (bytes 2 and 3 long within words and across
their edges), weighted by counts and a smoothed inverse document frequency and scaled to unit
length. Each language of the labelled sample gets several centroids by spherical
k-means. A text takes the language of its nearest centroid by cosine; its score is that
cosine. The smoothing was chosen on a split of training rows alone. A text too far from every centroid for its length is marked as rejected.

The model is fitted on a bounded sample (about `per_language` labelled rows of each
language, by a hash of doc_id) on the driver and broadcast: a few hundred KB, set by the
number of languages, `clusters` and `size`. Prediction is one narrow pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = T.LOWER.copy()
_FOLD[:0x80][~np.isin(np.arange(0x80), [*range(0x41, 0x5B), *range(0x61, 0x7B)])] = 0x20


def vectors(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x size), and the number of n-grams of each text. Each text
    stands between spaces of its own, so that its n-grams don't depend on the texts beside it."""
    begin = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts])))
    raw = _FOLD[np.frombuffer(b"".join(b" " + t + b" " for t in texts) + b"  ", dtype=np.uint8)]
    upper = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    raw[upper] += 0x20  # capital letters of Latin-1
    a, b, c = (raw[k : k + begin[-1]].astype(np.uint32) for k in range(3))
    two = (a << 8 | b) * np.uint32(0x9E3779B1)
    three = ((a << 16 | b << 8 | c) * np.uint32(0x85EBCA6B)) ^ np.uint32(0x5BD1E995)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    inside = (a != 0x20) | (b != 0x20)
    counts = np.zeros(len(texts) * size, dtype=np.float32)
    total = np.zeros(len(texts), dtype=np.int64)
    shift = np.uint32(32 - (size.bit_length() - 1))
    for code, use in ((two, inside), (three, inside & (b != 0x20))):
        own = owner[use]
        counts += np.bincount(own * size + (code[use] >> shift), minlength=len(counts)).astype(np.float32)
        total += np.bincount(own, minlength=len(texts))
    return counts.reshape(len(texts), size), total


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows far from each other.
    Clusters of fewer than one row in twenty go."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    for _ in range(1, min(k, len(x))):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        centroids = _unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))]))
    sizes = np.bincount(np.argmax(x @ centroids.T, axis=1), minlength=len(centroids))
    return centroids[sizes >= min(0.05 * len(x), sizes.max())]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        counts, total = vectors(texts, len(self.weights))
        near = _unit(counts * self.weights) @ self.centroids.T
        best = np.argmax(near, axis=1) if len(self.centroids) else np.zeros(len(texts), np.int64)
        score = np.clip(near[np.arange(len(texts)), best] if len(self.centroids) else np.zeros(len(texts)), 0, 1).astype(np.float64)
        far = score < self.floors[_length_class(total)]
        names = []
        for i, t in enumerate(texts):
            known = len(self.centroids) and (t.isascii() and t.upper() != t.lower() or _LETTER.search(t.decode()))
            names.append(self.languages[self.language_of[best[i]]] if known else UNKNOWN)
            if not known:
                score[i], far[i] = 0.0, True
        return names, score, far


def _length_class(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), 15)


def fit(labelled: DataFrame, per_language: int = 1000, max_rows: int = 8000, clusters: int = 4, size: int = 4096, smooth: float = 2.0) -> Model:
    """A model from the columns doc_id, text and lang; rows with a null in any of them and
    texts without letters teach nothing. About `per_language` rows of a language are used, and
    about `max_rows` in all."""
    rows = labelled.select("doc_id", "text", "lang").dropna().where(F.expr(r"text rlike '\\p{L}'"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return Model([], np.zeros(size, np.float32), np.zeros((0, size), np.float32), np.zeros(0, np.int64), np.zeros(16))
    per_language = min(per_language, max_rows / len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(place < share[F.col("lang")]).select("lang", "text").toArrow()
    names, texts = sample["lang"].to_pylist(), T.byte_list(sample["text"])
    # one matrix, filled and scaled in place: the driver holds no second one
    x, total = np.empty((len(texts), size), dtype=np.float32), np.empty(len(texts), dtype=np.int64)
    seen = np.zeros(size, dtype=np.int64)
    for i, j in T.spans(texts, 1 << 20):
        for k in range(i, j, 512):
            end = min(j, k + 512)
            x[k:end], total[k:end] = vectors(texts[k:end], size)
            seen += (x[k:end] > 0).sum(axis=0)
    weights = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + np.float32(smooth)  # smoothed: a rare passage in another language must not outweigh the rest
    for k in range(0, len(x), 512):
        x[k : k + 512] = _unit(x[k : k + 512] * weights)
    languages = sorted(set(names))
    label = np.array([languages.index(n) for n in names])
    means = _unit(np.stack([x[label == k].mean(axis=0) for k in range(len(languages))]))
    own = np.argmax(x @ means.T, axis=1) == label  # rows nearer to another language's mean are taken for wrong labels
    own |= ~np.isin(label, label[own])
    centroids = [_clusters(x[own & (label == k)], clusters) for k in range(len(languages))]
    language_of = np.repeat(np.arange(len(languages)), [len(c) for c in centroids])
    centroids = np.concatenate(centroids)
    best, length = (x @ centroids.T).max(axis=1)[own], _length_class(total[own])
    floors = np.array([0.3 * best[length == k].min() if (length == k).sum() >= 20 else 0.02 for k in range(16)])
    del x, texts, sample
    T.tidy()
    return Model(languages, weights, centroids, language_of, floors)


def predict(documents: DataFrame, model: Model, block_bytes: int = 1 << 20) -> DataFrame:
    """`documents` with lang_pred (`und` for a null text or one without a letter), lang_score
    (0 to 1) and lang_rejected. A very long text is read as a whole; of equally near centroids the
    first language in order wins. Rows are independent: repeated rows give equal results, and an
    empty table gives no rows. Columns of these names are replaced, others pass through."""
    T.small_batches(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = documents.drop("lang_pred", "lang_score", "lang_rejected")
    out = out.withColumns({"lang_pred": F.lit(None).cast("string"), "lang_score": F.lit(None).cast("double"), "lang_rejected": F.lit(None).cast("boolean")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = T.byte_list(b.column("text"))
            names, scores, far = [], [np.empty(0)], [np.empty(0, bool)]
            for i, j in T.spans(texts, block_bytes):
                for k in range(i, j, 512):
                    own = shared.value.predict(texts[k : min(j, k + 512)])
                    names += own[0]
                    scores.append(own[1])
                    far.append(own[2])
            columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"lang_pred": pa.array(names, pa.string()), "lang_score": pa.array(np.concatenate(scores)), "lang_rejected": pa.array(np.concatenate(far))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return out.mapInArrow(T.lean(run), out.schema)


def held_out(modulus: int, remainder: int):
    """Whether crc32 of doc_id as text leaves that remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a model learned from those that are not held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents.where(~held_out(4, 2)))
    out = predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))

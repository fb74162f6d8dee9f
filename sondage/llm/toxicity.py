"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding maps case, accents, look-alike letters of other scripts, full-width forms and
digits or signs that stand for letters to plain letters; letters that share a sign share a
fold (i, l, 1, | and ! are one). Lexicon entries are whole words or word beginnings; one
automaton finds all of them in one pass over the text. Exception phrases (an entry with
the word before or after it, seen in harmless rows or given) cancel the hit inside them.
The weights of a text's hits, as a sum and normalised by length, give its score.

The lexicon and the score are fitted on the driver from a bounded sample of labelled rows;
the lexicon holds at most `max_entries` entries, so its broadcast is bounded too.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .langid import held_out

#: Letters of other alphabets that look like a Latin letter, and that letter.
LOOKALIKES = dict(zip("αβεικνορτυχϲаеорсухіјѕһԁвкмнтғı", "abeiknoptuxcaeopcyxijshdbkmhtfi", strict=True))
#: Digits and signs that stand for a letter. Signs count only between letters.
SUBSTITUTES = dict(zip("0134578@$!|+", "oieastbasiit", strict=True))
SIGNS = "@$!|+"
_SPACE = 0x20


def _fold_letter(c: str) -> int:
    """The fold of a character: a plain letter, or 0 to keep it as it is."""
    c = unicodedata.normalize("NFKD", c.lower())[:1].lower()
    c = LOOKALIKES.get(c, c)
    c = SUBSTITUTES.get(c, c) if c not in SIGNS else c
    c = "i" if c == "l" else c
    return ord(c) if "a" <= c <= "z" else 0


_ONE = np.full(256, _SPACE, dtype=np.uint8)
for _b in range(0x80):
    _ONE[_b] = _fold_letter(chr(_b)) or _SPACE
_ONE[0x80:] = np.arange(0x80, 0x100)
_SIGN = np.zeros(256, dtype=np.uint8)
for _c in SIGNS:
    _SIGN[ord(_c)] = _fold_letter(SUBSTITUTES[_c])
#: By lead byte - 0xC0 and low six bits of the next byte: the fold of a two-byte character.
_TWO = np.array([_fold_letter(chr(k)) if k >= 0x80 else 0 for k in range(0x800)], dtype=np.uint8)


def fold(raw: np.ndarray) -> np.ndarray:
    """Folded bytes: letters, bytes of other characters, and spaces for all else."""
    out, keep = _ONE[raw], np.ones(len(raw), dtype=bool)
    signs = np.flatnonzero(_SIGN[raw])
    signs = signs[(signs > 0) & (signs < len(raw) - 1)]
    letter = (out >= 97) & (out <= 122)
    inside = signs[letter[signs - 1] & letter[signs + 1]]
    out[inside] = _SIGN[raw[inside]]
    lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xDF))
    to = _TWO[((raw[lead].astype(np.int64) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)]
    lead, to = lead[to > 0], to[to > 0]
    out[lead], keep[lead + 1] = to, False
    wide = np.flatnonzero((raw[:-2] == 0xEF) & ((raw[1:-1] == 0xBC) | (raw[1:-1] == 0xBD)))  # U+FF00 to U+FF7F
    if len(wide):
        plain = (((raw[wide + 1].astype(np.int64) & 0x3F) << 6) | (raw[wide + 2] & 0x3F)) - 0xF00 + 0x20
        to = np.where((plain > 0x20) & (plain < 0x7F), _ONE[np.clip(plain, 0, 0x7F)], 0)
        wide, to = wide[to > _SPACE], to[to > _SPACE]
        out[wide], keep[wide + 1], keep[wide + 2] = to, False, False
    return out[keep]


def folded(texts: list[bytes]) -> list[str]:
    """Each text folded, its words with one space before each and one at the end, one
    character for a byte."""
    if not texts:
        return []
    joined = fold(np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", dtype=np.uint8))
    same = (joined[1:] == _SPACE) & (joined[:-1] == _SPACE)
    joined = joined[np.concatenate(([True], ~same))]
    return [f" {t.strip()} " for t in joined.tobytes().decode("latin-1").split("\xff")[1:-1]]


@dataclass
class Lexicon:
    weights: dict[str, float]  # " word " or " beginning"
    exceptions: set[str] = field(default_factory=set)  # " word word "
    coef: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def automaton(self) -> ahocorasick.Automaton:
        auto = ahocorasick.Automaton()
        for term, w in self.weights.items():
            auto.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            auto.add_word(phrase, (len(phrase), 0.0))
        if len(auto):
            auto.make_automaton()
        return auto

    def features(self, auto: ahocorasick.Automaton, texts: list[bytes]) -> np.ndarray:
        """1, damped sum of weights, weight for each damped word, number of hits damped."""
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        if not len(auto):
            return out
        for i, t in enumerate(folded(texts)):
            hits: dict[int, float] = {}
            spared: list[tuple[int, int]] = []
            for end, (size, w) in auto.iter(t):
                at = end + 1 - size
                if w:
                    hits[at] = max(w, hits.get(at, 0.0))
                else:
                    spared.append((at, end))
            if spared:
                hits = {a: w for a, w in hits.items() if not any(x <= a < y for x, y in spared)}
            if hits:
                total = sum(hits.values())
                out[i, 1:] = np.log1p(total), total / (1 + np.log1p(t.count(" "))), np.log1p(len(hits))
        return out

    def scores(self, auto: ahocorasick.Automaton, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(auto, texts) @ self.coef, -30, 30)))


def _terms(text: str, lengths: Iterable[int]) -> set[str]:
    words = set(text.split())
    out = {f" {w} " for w in words}
    for n in lengths:
        out |= {f" {w[:n]}" for w in words if len(w) >= n}
    return out


def learn(texts: list[bytes], labels: np.ndarray, max_entries: int = 2000, lengths: tuple[int, ...] = (4, 5, 6), least: int = 3, cover: int = 6, exceptions: Iterable[str] = ()) -> Lexicon:
    """A lexicon and score from labelled texts.

    Terms that are far more frequent in toxic texts are taken while they still explain
    texts that have fewer than `cover` terms, so words of one topic or of a group of copies
    add nothing once the group is explained. Equal texts count once.
    """
    seen: dict[str, int] = {}
    for t, y in zip(folded(texts), labels.tolist(), strict=True):
        seen[t] = max(y, seen.get(t, 0))
    toxic = [t for t, y in seen.items() if y]
    clean = [t for t, y in seen.items() if not y]
    with_term = Counter(x for t in toxic for x in _terms(t, lengths))
    # of so many terms none should be in this many toxic texts and no clean one by chance
    chance = (len(toxic) + 1) / (len(seen) + 2)
    least = max(least, int(np.ceil(np.log(len(with_term) + 1) / -np.log(chance))))
    with_term = {x: n for x, n in with_term.items() if n >= least}
    wanted = with_term.keys()
    without = Counter(x for t in clean for x in _terms(t, lengths) if x in wanted)
    p, n = max(1, len(toxic)), max(1, len(clean))
    odds = {x: float(np.log((with_term[x] + 0.5) / (p + 1)) - np.log((without[x] + 0.5) / (n + 1))) for x in wanted}
    good = {x for x in wanted if odds[x] > 2 and without[x] <= 0.02 * with_term[x]}
    of: dict[str, list[int]] = {}
    for i, t in enumerate(toxic):
        for x in _terms(t, lengths) & good:
            of.setdefault(x, []).append(i)
    missing = np.full(len(toxic), cover)
    chosen: dict[str, float] = {}
    longest: dict[str, int] = {}  # beginning -> most texts of a chosen term that it begins
    for x in sorted(of, key=lambda x: (-len(of[x]), -len(x), x)):
        own = of[x]
        if len(chosen) >= max_entries:
            break
        if any(x[:k] in chosen for k in range(2, len(x))) or len(own) <= 1.05 * longest.get(x, 0):
            continue  # a chosen beginning finds it, or it finds little more than a chosen word
        if (missing[own] > 0).sum() >= max(least, 0.25 * len(own)):
            chosen[x] = min(odds[x], 10.0)
            missing[own] -= 1
            for k in range(2, len(x)):
                longest[x[:k]] = max(len(own), longest.get(x[:k], 0))
    around = Counter()
    for t in clean:
        words = t.split()
        for a, b in zip(words, words[1:], strict=False):
            if any(f" {w} " in chosen or any(f" {w[:k]}" in chosen for k in lengths) for w in (a, b)):
                around[f" {a} {b} "] += 1
    spared = {x for x, k in around.items() if k >= 3 and not any(x in t for t, y in seen.items() if y)}
    for phrase in exceptions:
        spared.add(folded([phrase.encode()])[0])
    lexicon = Lexicon(chosen, spared)
    x, y = lexicon.features(lexicon.automaton(), texts), labels.astype(float)
    coef, keep = np.zeros(4), np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(40):  # Newton steps of a logistic regression with a small penalty
        q = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        coef = coef - np.linalg.solve((x.T * (q * (1 - q))) @ x + keep + 1e-9 * np.eye(4), x.T @ (q - y) + keep @ coef)
    return Lexicon(chosen, spared, coef)


def fit(documents: DataFrame, labels: DataFrame, toxic_rows: int = 2500, clean_rows: int = 5000, **options) -> Lexicon:
    """From texts (doc_id, text) and labels (doc_id, toxic).

    About so many labelled rows of each label are used, chosen by a hash of doc_id before
    their texts are looked up, so that only these few keys are broadcast and no text is
    shuffled. Rows with a null in any of the columns and other labels teach nothing.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().where("toxic in (0, 1)")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_rows / counts.get(1, 1))).otherwise(min(1.0, clean_rows / counts.get(0, 1)))
    chosen = F.broadcast(rows.where(place < share))
    sample = documents.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("text", "toxic").toArrow()
    return learn(T.byte_list(sample["text"]), sample["toxic"].to_numpy(), **options)


def score(documents: DataFrame, lexicon: Lexicon, block_bytes: int = 1 << 20) -> DataFrame:
    """`documents` with `toxicity` (0 to 1). Null and empty texts have no hits and get the
    score of such texts. A very long text is read as a whole. Rows are independent: repeated rows
    give equal results, and an empty table gives no rows. A column of that name is replaced,
    others pass through."""
    T.small_batches(documents)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    out = documents.drop("toxicity").withColumn("toxicity", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value.automaton()
        for b in batches:
            texts = T.byte_list(b.column("text"))
            parts = [np.empty(0), *(shared.value.scores(auto, texts[i:j]) for i, j in T.spans(texts, block_bytes))]
            columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"toxicity": pa.array(np.concatenate(parts))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return out.mapInArrow(T.lean(run), out.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a lexicon learned from labels that are not held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(3, 1)).select("doc_id", "toxic")
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))

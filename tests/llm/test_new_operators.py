"""Trie of conversations, quality rules and importance resampling against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import conversation_trie, importance, quality

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Names that the operators use themselves.
CLASH = ["_row", "_own", "_two", "_buckets", "_at", "_g", "_n", "_full", "centre", "inverse", "scale", "bucket", "node", "family", "ends", "n_features", "_before", "_all", "kept", "distance", "n_distinct", "_w", "_h", "_x0"]


def clashing(frame):
    return frame.withColumns({c: F.lit(1) for c in CLASH})


# importance


def features(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return ws, [" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def resampled(docs, items, percent=5, least=20, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x)[1]) for rows in (docs, items))
    total = lambda c: float(sum(c.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * total(s) / ((s[b] + 1.0) * total(t))))
    out, fit = [], []
    for d, x in docs:
        ws, fs = features(x)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(fs), weight, score, None])
        if len(ws) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def documents(seed=3, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Été", "NaÏve", "x\x00y", "it's", "ÀB"]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "..."), (903, "one"), (904, "one two"), (905, " ".join(words * 300)), (906, rows[5][1]), (907, rows[5][1]), (5, rows[5][1]), (None, rows[7][1])]


def test_importance_against_plain_version(spark):
    docs, items = documents(), documents(9, 12)
    frame = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    target = spark.createDataFrame(items, "item_id long, text string")
    for percent, least in ((5, 20), (50, 1), (100, 20), (0, 20)):
        got = importance.resample(frame, target, percent, least)
        assert set(CLASH) <= set(got.columns) and got.where("_own != 1 or _at != 1 or bucket != 1").count() == 0
        rows = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
        want = resampled(docs, items, percent, least)
        # the two rows of document 5 are equal in all that orders them
        assert rows == want


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(documents()[:30], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    got = sorted((tuple(r) for r in importance.resample(some, none).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == resampled(documents()[:30], [])


# conversations


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: (y[0], y[1] or 0, y[2], y[3]))] for c, v in convs.items()}
    seq = {}
    for c, v in own.items():
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        seq[c] = tuple(own.get(base, [])[:h] + v[h:]) if base != c else tuple(v)
    members = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(seq[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=1, n=70):
    rng = random.Random(seed)
    turns = [("user", "hi"), ("assistant", "hello, été"), ("user", ""), ("system", None), (None, "x")]
    rows = []
    for c in [*range(n), 1003, -7, -5, -10, 2**40 + 1]:
        if rng.random() < 0.9:
            rows += [(c, k, *rng.choice(turns[: 1 + min(k + 1, 4)])) for k in range(rng.randint(1, 12))]
    rows += [(c, 0, "user", "same") for c in range(200, 260)]  # a large group of copies
    rows += [(300, None, "user", "b"), (300, None, "user", "a"), (300, 2, "user", "c"), (300, 2, "user", "c"), (None, 1, "user", "nobody"), (301, -4, "z", "q" * 50_000)]
    rows += [(400, k, "user", f"turn {k}") for k in range(3000)]  # one long conversation
    return rows


@pytest.mark.parametrize("most", [3, 20_000])
def test_trie_against_plain_version(spark, most):
    rows = [r for r in conversations() if r[0] != 400]
    frame = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    got = conversation_trie.trie(frame, most_nodes=most).drop("node", "parent")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_a_long_conversation(spark):
    rows = [r for r in conversations() if r[0] == 400]
    got = conversation_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most_nodes=100)
    assert got.agg(F.count("*"), F.sum("n_leaves"), F.max("depth"), F.sum("saved_tokens")).first()[:] == (3001, 3001, 3000, 0)


def test_trie_of_no_conversation(spark):
    for rows in ([], [(None, 1, "user", "a")]):
        assert conversation_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 0


# quality


def counts(text):
    text = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    again = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(set(ws)), len(re.findall("[A-ZÀ-ÖØ-Þ]", text)), len(re.findall("[.,;:!?]", text)))


def test_counts_against_plain_version(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\r\n", "a", "a b", "a b c", "a a a a a", "x y z x y z", "x y z w x y z", "É🎈 #1 $5 | a\x0bb\x0cc", "same\nsame\n same\n\n\nother\nsame", "\n\n", " lead and trail ", "<|>" * 7, "q" * 100_000, "u v w " * 30_000, "a b c\x85d", "A.B!C?"]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(100)]
    frame = clashing(spark.createDataFrame(list(enumerate([*texts, texts[-1]])), "doc_id long, text string").repartition(3))
    got = quality.statistics(frame)
    assert got.where("_w != 1 or _row != 1").count() == 0
    rows = {r["doc_id"]: tuple(r[c] for c in quality.COUNTS) for r in got.collect()}
    for i, t in enumerate([*texts, texts[-1]]):
        assert rows[i] == counts(t), repr(t)[:60]


def concentrated(x, floors, alpha=0.75, steps=30):
    """The least determinant among many random starts, floors in the scatter: centre and scatter."""
    rng, best, h = np.random.default_rng(0), None, int(np.ceil(alpha * len(x)))
    for _ in range(40):
        own = x[rng.choice(len(x), 12, replace=False)]
        for _ in range(steps):
            m, s = own.mean(axis=0), np.cov(own.T, bias=True) + np.diag(floors**2)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            own = x[np.argsort(d, kind="stable")[:h]]
        m, s = own.mean(axis=0), np.cov(own.T, bias=True) + np.diag(floors**2)
        if best is None or np.linalg.det(s) < best[0]:
            best = (np.linalg.det(s), m, s)
    return best


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    p = quality.P
    mix = rng.standard_normal((p, p)) * 0.4 + np.eye(p)
    good = rng.standard_normal((900, p)) @ mix
    bad = 12 + rng.standard_normal((180, p))
    x = np.concatenate((good, bad))
    rows = [("g", *v) for v in x.tolist()] + [("h", *(v * 3 + 1)) for v in rng.standard_normal((300, p)).tolist() for v in [np.array(v)]]
    rows = [(r[0], *map(float, r[1:])) for r in rows]
    frame = spark.createDataFrame(rows, "_g string, " + ", ".join(f"{c} double" for c in quality.X)).repartition(3)
    return x, frame


def test_estimates_against_random_starts(vectors):
    x, frame = vectors
    got = {r["_g"]: r for r in quality.estimates(frame, 2).collect()}
    det, centre, scatter = concentrated(x, np.array(list(quality.FLOORS.values())))
    inverse = np.array(got["g"]["inverse"]).reshape(quality.P, quality.P)
    assert 1 / np.linalg.det(inverse) <= 1.25 * det  # bins may take a few rows more
    assert np.allclose(got["g"]["centre"], centre, atol=0.25)
    d = np.einsum("ij,jk,ik->i", x - got["g"]["centre"], inverse, x - got["g"]["centre"]) / got["g"]["scale"]
    limit = quality.quantile(1 - 1e-6, quality.P)
    assert (d[900:] > limit).all() and (d[:900] <= limit).mean() > 0.99
    assert got["h"]["_n"] == 300


def test_inverse(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((quality.P, 20))
    m = a @ a.T
    row = spark.range(1).select(quality._inverse(F.array(*[F.lit(float(v)) for v in m.ravel()])).alias("i")).select("i.*").first()
    assert np.allclose(np.array(row["m"]).reshape(m.shape), np.linalg.inv(m)) and row["d"] == pytest.approx(np.linalg.slogdet(m)[1])


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))).capitalize() + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", ["hot", None, "", "few"][min(i % 40, 3) if i % 40 < 4 else 0]) for i in range(1200)]
    odd = [(5000 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "hot") for i in range(60)]
    short = [(7000, None, None, None), (7001, "", "en", "hot"), (7002, "one two", "en", "hot"), (7003, "a b c " * 40, "en", "hot"), (7004, prose(rng, 100), "xx", "alone"), (7004, prose(rng, 100), "xx", "alone")]
    frame = clashing(spark.createDataFrame(rows + odd + short, "doc_id long, text string, lang string, source string").repartition(4))
    counted = quality.statistics(frame).drop("text")
    got = quality.judged(counted)
    assert set(CLASH) <= set(got.columns) and got.count() == len(rows + odd + short)
    kept = {(r["doc_id"], r["kept"]) for r in got.collect()}
    assert all((i, True) in kept for i in range(1200)) and all((5000 + i, False) in kept for i in range(60))
    assert {(7000, False), (7001, False), (7002, False), (7003, False), (7004, True)} <= kept
    assert quality.judged(counted.limit(0)).count() == 0
    # a plan of few broadcasts and one of joins give the same verdicts
    most, quality.MOST_BROADCAST = quality.MOST_BROADCAST, 0
    try:
        assert {(r["doc_id"], r["kept"]) for r in quality.judged(counted).collect()} == kept
    finally:
        quality.MOST_BROADCAST = most

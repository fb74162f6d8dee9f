"""Each stage of the pipeline against a plain version of it, over all rows of the smallest tables."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from sondage.llm import bpe, langid, secret_scan

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*pipeline.COLUMNS).collect()]
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    odd = [(-5, a, "en", "s", 1), (-4, a, "en", "s", 1), (-4, b, "en", "s", 1), (-3, b + " more", "en", "s", 1), (-2, "c d e f g h", "en", "s", 1), (-2, "c d e f g h", "en", "s", 1), (None, a, "en", "s", 1), (None, "only here " + b[:40], None, None, None), (None, None, None, None, None), (900, "", "en", "s", 0)]
    return rows + odd


def table(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def out(frame):
    return Counter(tuple(r) for r in frame.select(*pipeline.COLUMNS).collect())


def test_language_stage(spark, documents):
    docs = table(spark, documents)
    model = langid.fit(docs)
    kept = out(pipeline.identify_language(spark, docs, FOLDER))
    for row in set(documents):
        t = row[1] or ""
        grams = Counter()
        raw = bytearray(langid._FOLD[np.frombuffer(f" {t} ".encode(), np.uint8)].tobytes())
        for i in range(1, len(raw)):
            if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
                raw[i] += 0x20
        raw += b"  "
        for i in range(len(raw) - 2):
            x, y, z = raw[i : i + 3]
            if (x, y) != (32, 32):
                grams[((x << 8 | y) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
                if y != 32:
                    grams[((x << 16 | y << 8 | z) * 0x85EBCA6B & 0xFFFFFFFF ^ 0x5BD1E995) >> 20] += 1
        v = np.zeros(4096)
        for g, n in grams.items():
            v[g] = n * model.weights[g]
        best = float((model.centroids @ (v / max(np.linalg.norm(v), 1e-12))).max())
        floor = float(model.floors[min(15, int(np.log2(max(1, sum(grams.values())))))])
        if abs(best - floor) > 1e-4:
            assert (row in kept) == (any(c.isalpha() for c in t) and best >= floor), row
    assert all(kept[r] in (0, n) for r, n in Counter(documents).items())


def test_near_duplicate_stage(spark, documents):
    def shingles(t):
        ws = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        return frozenset(" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()

    sets = [shingles(r[1]) for r in documents]
    group = list(range(len(documents)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]) > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for r, g in zip(documents, group, strict=True):
        first[g] = min(first.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert out(pipeline.drop_near_duplicates(spark, table(spark, documents), FOLDER)) == Counter(first.values())


def test_decontamination_stage(spark, documents):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        ws = word.findall((r["text"] or "").translate(LOWER))
        size = min(10, len(ws))
        for i in range(len(ws) - size + 1 if size else 0):
            windows.setdefault(size, set()).add(tuple(ws[i : i + size]))
    want = []
    for d, t, lang, source, n in documents:
        spots = list(word.finditer((t or "").translate(LOWER)))
        ws, hit = [m.group() for m in spots], set()
        for size, known in windows.items():
            for i in range(len(ws) - size + 1):
                if tuple(ws[i : i + size]) in known:
                    hit |= set(range(i, i + size))
        if len(hit) > 0.5 * len(ws):
            continue
        edges = [m.start() for m in spots] + [len(t or "")]
        text = None if t is None else t[: edges[0]] + "".join(t[edges[i] : edges[i + 1]] for i in range(len(ws)) if i not in hit)
        want.append((d, text, lang, source, n if text is None else len(text)))
    assert any(len(w[1] or "") != len(t or "") for w, (_, t, *_) in zip(want, documents, strict=False))
    assert out(pipeline.remove_benchmark(spark, table(spark, documents), FOLDER)) == Counter(want)


def test_secret_stage(spark, documents):
    key, other = "AKIA" + "J5XKQ2M7RT4WZ8PL", "ghp_" + "k3J9sQ0xVb7Lm2Np5Rt8Wy1Za4Cd6Ef9Gh2Q"
    texts = [f"{key} at the start, token={other}", f'{{"a":1,"auth_token":"{other}"}}', f"{other};{key};{key}", "no secret here at all"]
    docs = table(spark, documents + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts)])
    trees = secret_scan.forest(secret_scan.train(secret_scan.labelled_findings(spark)))
    want = []
    for r in secret_scan.scan(docs, trees).collect():
        text = r["text"]
        for v in sorted({s["value"] for s in r["secrets"]}, key=len, reverse=True):
            text = text.replace(v, "[SECRET]")
        want.append((r["doc_id"], text, r["lang"], r["source"], r["n_chars"] if text is None else len(text)))
    assert any("[SECRET]" in (w[1] or "") for w in want)
    assert out(pipeline.redact_secrets(spark, docs, FOLDER)) == Counter(want)


def test_encoding_stage(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rows = pipeline.encode(spark, table(spark, documents), FOLDER).collect()
    assert Counter(tuple(r[c] for c in pipeline.COLUMNS) for r in rows) == Counter(documents)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline.storage, "shared_folder", lambda _: str(tmp_path))
    assert pipeline.run(spark, FOLDER).count() > 0
    made = [p for p in tmp_path.glob("pipeline-*/*")]
    assert [p.name for p in made] == [str(len(pipeline.STAGES) - 1)]

"""The text operators on small tables: brute force, odd rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from sondage.llm import ann, bpe, components, decontam, langid, licenses, secret_scan, simhash, substring_dedup, token_pack, toxicity

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Columns whose names the operators use themselves.
CLASH = ["n_words", "hit_words", "lang_pred", "lang_rejected", "toxicity", "ids", "decoded", "secrets", "licenses", "bucket", "chunk", "fingerprint", "_row"]


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def corpus(seed=1, n=60):
    """Documents with copies, shared passages, odd texts, nulls and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ñu"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 5 == 0:
            own[3:3] = passage[rng.randint(0, 8) :]
        if i % 11 == 3:
            own = rows[-1][1].split() if rows and rows[-1][1] else own
        rows.append((i * 3, " \n"[i % 2].join(own)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "x"), (504, " ".join(vocabulary * 12)), (505, "a\x0bB c"), (505, "a\x0bB c"), (None, "null id " + " ".join(passage)), (506, "..."), (507, "x" * 20000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    return frame.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def window_dedup(rows, size):
    first = defaultdict(set)
    for d, t in rows:
        ws = words(t)
        for i in range(len(ws) - size + 1):
            first[tuple(ws[i : i + size])].add(float("inf") if d is None else d)
    out = []
    for d, t in rows:
        ws, gone = words(t), set()
        for i in range(len(ws) - size + 1):
            if min(first[tuple(ws[i : i + size])]) < (float("inf") if d is None else d):
                gone |= set(range(i, i + size))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "period"), [(13, 7), (5, 3), (4, 1), (7, 7)])
def test_substring_dedup(docs, size, period):
    got = substring_dedup.dedup(docs, size, period, chunk_bytes=3000, block_bytes=700).collect()
    assert sorted((tuple(r) for r in got), key=str) == window_dedup(corpus(), size)


def simhash_of(t, size=3):
    ws = words((t or "").translate(LOWER))
    shingles = [" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in keys:
        for b in keys:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_groups(spark, docs):
    rows = corpus() + [(900 + i, f"{corpus()[7][1]} extra{i}") for i in range(6)]
    prints = [simhash_of(t) for _, t in rows]
    parts = joined(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            least[parts[p]] = min(d, least.get(parts[p], d))
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(d, p, least.get(parts[p])) for (d, _), p in zip(rows, prints, strict=True)]
    assert sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in got), key=str) == sorted(want, key=str)
    assert simhash.groups(docs).count() == len(corpus())


@pytest.mark.parametrize("split", [20_000, 2, 0])
def test_large_buckets_are_dealt_again(spark, split):
    rng = random.Random(3)
    prints = {0, 1, 3, 2**64 - 1}
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    want = joined(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    links = simhash.near_prints(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 3, split)
    got = {r["u"]: r["v"] for r in components.components(links).collect()}
    assert {x: got.get(x, x) for x in signed} == want


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [f"v{rng.randint(0, 3000)}" for _ in range(220)]
    rows = corpus(2)
    for i in range(8):
        near = list(base)
        near[20 * i] = "changed"
        rows.append((2000 + i, " ".join(near)))
    far = base[:60] + [f"q{i}" for i in range(160)]
    rows.append((3000, " ".join(far)))

    def shingles(t):
        ws = words((t or "").translate(LOWER))
        return frozenset(" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()

    sets = sorted({shingles(t) for _, t in rows}, key=sorted)
    number = {s: i for i, s in enumerate(sets)}
    parts = joined(range(len(sets)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    least = {}
    for d, t in rows:
        part = parts[number[shingles(t)]]
        if d is not None:
            least[part] = min(d, least.get(part, d))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(((d, least.get(parts[number[shingles(t)]])) for d, t in rows), key=str)


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 200), (300, 301), (301, 300)]
    nodes = sorted({x for p in pairs for x in p})
    links = set(pairs) | {(b, a) for a, b in pairs}
    want = joined(nodes, lambda a, b: (a, b) in links)
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def brute_hits(text, items, n):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    ws, hit, names = re.findall(pattern, (text or "").translate(LOWER)), set(), set()
    for name, item in items:
        other = re.findall(pattern, (item or "").translate(LOWER))
        size = min(n, len(other))
        for a in range(len(other) - size + 1 if size else 0):
            for i in range(len(ws) - size + 1):
                if ws[i : i + size] == other[a : a + size]:
                    hit |= set(range(i, i + size))
                    names.add(str(name))
    return len(ws), sorted(hit), sorted(names)


def test_decontamination(spark, docs):
    passage = next(t for d, t in corpus() if d is None)
    items = [(1, passage), (2, "A b, C"), (10, None), (11, "?!"), (12, " ".join(f"w{i}" for i in range(50, 70))), (13, "X"), (14, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((d, *brute_hits(t, items, 10)) for d, t in corpus()), key=str)
    for limit in (1 << 20, 40):  # one automaton, and several
        got = decontam.hits(docs, bench, 10, max_bytes=limit, block_bytes=500).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["hit_words"], r["hit_items"]) for r in got), key=str) == want
    cut = {r["doc_id"]: r for r in decontam.remove_hits(docs, bench).collect()}
    assert None not in cut and 501 in cut and cut[500]["text"] is None
    texts = dict(corpus())
    for d, r in cut.items():
        n, hit, _ = brute_hits(texts[d], items, 10)
        assert len(hit) <= 0.5 * n
        assert (r["text"] == texts[d]) == (not hit)
        assert brute_hits(r["text"], [(0, "x")], 10)[0] == n - len(hit)
    assert decontam.hits(docs, bench.limit(0)).where("size(hit_words) > 0").count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(6)
    stems = {"aa": ["thing", "the", "with", "ough"], "bb": ["schen", "keit", "über", "der"], "cc": ["ción", "ndo", "que", "los"]}
    rows = []
    for i in range(300):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang))
    table = spark.createDataFrame([*rows, (999, None, "aa"), (998, "12 ...", "bb"), (None, "thing", "aa"), (997, "thing", None)], "doc_id long, text string, lang string")
    model = langid.fit(table.where(~langid.held_out(4, 2)))
    got = langid.predict(table, model).where(langid.held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    odd = {r["doc_id"]: r for r in langid.predict(docs.drop("lang_pred").withColumn("lang_pred", F.lit(1)), model).where("doc_id >= 500").collect()}
    assert [odd[d]["lang_pred"] for d in (500, 501, 502, 506)] == ["und"] * 4 and all(odd[d]["lang_rejected"] for d in (500, 501))
    assert odd[503]["lang_pred"] != "und" and all(0 <= r["lang_score"] <= 1 for r in odd.values())
    nothing = langid.fit(empty)
    assert langid.predict(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        own = [f"{rng.choice('bcdfg')}{rng.choice('aeo')}{rng.choice('nrt')}{rng.randint(0, 99)}x" for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            own.insert(rng.randint(0, len(own)), rng.choice(["vilewort", "grobling", "schurk" + rng.choice("aeiou") + rng.choice("bcd")]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (7777, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(table, marks.where(~langid.held_out(3, 1)), exceptions=["vilewort garden"])
    scored = toxicity.score(table, lexicon).join(marks, "doc_id").where(langid.held_out(3, 1) & F.col("toxic").isNotNull()).collect()
    assert all((r["toxicity"] >= 0.7) == bool(r["toxic"]) for r in scored)
    texts = [(1, "a v1lewort here"), (2, "a vilеwort, here"), (3, "the vilewort garden"), (4, "a vi lewort"), (5, None), (6, ""), (7, "VILEWORT " + "word " * 3000)]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), lexicon).collect()}
    assert got[1] >= 0.7 and got[2] >= 0.7 and got[7] > got[4] and max(got[3], got[4], got[5], got[6]) < 0.7
    assert toxicity.score(docs, lexicon).count() == len(corpus())
    none = toxicity.fit(empty, marks.limit(0))
    assert {round(r["toxicity"], 3) for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(empty, lexicon).count() == 0


def test_token_packing(docs, empty):
    from public_tokenizers import PATTERN

    coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=token_pack.read_ranks(token_pack.default_path()), special_tokens={})
    packed = token_pack.packed(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), length=64, window_tokens=900)
    for r in packed.collect():
        edges = list(r["cumulative"])
        assert edges[0] == 0 and edges[-1] == r["n_tokens"] <= 64 and [b - a for a, b in zip(edges, edges[1:], strict=False)] == [s["tokens"] for s in r["segments"]]
        places = np.frombuffer(r["positions"], "<i4")
        assert len(r["ids"]) == 128 and places.tolist() == [i for s in r["segments"] for i in range(s["tokens"])] + [0] * (64 - r["n_tokens"])
    got = {r["doc_id"]: r["ids"] for r in token_pack.unpack(packed, 64).collect()}
    assert got == {d: coder.encode_ordinary(t) for d, t in corpus() if t and d is not None}
    assert token_pack.packed(empty).count() == 0
    assert sum(len(r["segments"]) for r in token_pack.packed(docs).where("exists(segments, s -> s.doc_id is null or s.doc_id = 505)").collect()) >= 3


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    got = bpe.decode(bpe.encode(docs, block_bytes=400)).collect()
    assert len(got) == len(corpus())
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_secrets(spark, docs, empty):
    trees = secret_scan.forest(secret_scan.train(secret_scan.labelled_findings(spark)))
    fresh = secret_scan.labelled_findings(spark, 9000, first=6000).withColumn("text", F.concat_ws(" ", "before", "word", "after", F.lit("and more"))).select("label", "text")
    counts = {(r["label"], r["found"]): r["count"] for r in secret_scan.scan(fresh, trees).groupBy("label", (F.size("secrets") > 0).alias("found")).count().collect()}
    assert counts.get((0, True), 0) == 0 and counts[(1, True)] > 100 * counts.get((1, False), 0)
    key = "AKIA" + "J5XKQ2M7RT4WZ8PL"
    text = f'some {key} words token = "{hashlib.sha1(b"q").hexdigest()}" and {key} mail rose.12@mail5.example.com commit {hashlib.sha1(b"c").hexdigest()}'
    rows = spark.createDataFrame([(1, text, 1), (2, None, 2), (3, "", 3)], "doc_id long, text string, secrets int")
    found = {r["doc_id"]: [s["value"] for s in r["secrets"]] for r in secret_scan.scan(rows, trees).collect()}
    assert found == {1: [key, hashlib.sha1(b"q").hexdigest(), key], 2: [], 3: []}
    clean = {r["doc_id"]: r for r in secret_scan.redact(rows, trees).collect()}
    assert key not in clean[1]["text"] and "rose.12@mail5.example.com" in clean[1]["text"] and hashlib.sha1(b"c").hexdigest() in clean[1]["text"]
    assert clean[2]["text"] is None and clean[3]["text"] == "" and clean[1]["secrets"] == 1
    assert secret_scan.scan(docs, trees).count() == len(corpus()) and secret_scan.scan(empty, trees).count() == 0


def test_licenses(spark, docs, empty):
    s = licenses.SENTENCES
    full = "\n".join(['Licensed under the Apache License, Version 2.0 (the "License");', *(s[k] for k in ("apache_2", "apache_3", "apache_4", "apache_5"))])
    rows = [(1, f"Foo bar.\n{full}\nend"), (2, "x. Released under the MIT License. y"), (3, "This work is licensed under the GNU General Public License, version 3.".upper() + " Licensed under CC BY-NC 4.0."), (4, s["apache_2"]), (5, None), (6, "licensed to nobody"), (7, " ".join([s["bsd_1"], s["bsd_2"], s["bsd_3"], "Neither the name of Foo nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."])), (8, " ".join([s["bsd_1"], s["bsd_2"], s["bsd_3"]]))]
    got = {r["doc_id"]: list(r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["MIT"], 3: ["CC-BY-NC-4.0", "GPL-3.0"], 4: [], 5: [], 6: [], 7: ["BSD-3-Clause"], 8: ["BSD-2-Clause"]}
    assert licenses.scan(docs).count() == len(corpus()) and licenses.scan(empty).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[::3] *= 2.5
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, 2.0]), (2080, [None] + [1.0] * 15), (None, [1.0] * 16), (5, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(table, table.where(F.col("vec_id") % 20 == 0), data_rows=200, query_rows=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    right = 0
    for q, found in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        order = [i for i in sorted(range(900), key=lambda i: (-round(scores[i], 9), i)) if i != q][:20]
        assert len(found) == 20 and all(abs(s - scores[i]) < 1e-9 for i, s in found) and q not in dict(found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        right += len(set(order) & {i for i, _ in found})
    assert right >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.0]), (22, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in ann.nearest(few, few.where("vec_id = 20")).orderBy("rank").collect()] == [(20, 1, 21), (20, 2, 22)]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_chi_square():
    rng = np.random.default_rng(1)
    sample = (rng.standard_normal((200000, 8)) ** 2).sum(axis=1)
    for at in (2.0, 7.0, 15.5):
        assert abs(float(ann.chi_square(np.array([at]), 8)[0]) - (sample <= at).mean()) < 5e-3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    rows = docs.collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert not any("AKIA" in r["text"] for r in rows)
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in rows[:40]:
        n, hit, _ = brute_hits(before[r["doc_id"]], items, 10)
        if hit:
            assert r["text"] != before[r["doc_id"]]
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0

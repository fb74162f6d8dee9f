"""Near duplicates in large buckets: dealt over tasks, they link as they do in one."""

import random

import pytest

from sondage.llm import simhash


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    """A group of near copies, documents that share half of their words and are near in pairs,
    small ones, and some of other sizes."""
    dice = random.Random(5)
    origin = [f"o{i}" for i in range(120)]
    out = []
    for k in range(150):
        words = list(origin)
        for at in dice.sample(range(len(words)), dice.choice((1, 2, 3))):
            words[at] = f"z{k}x{at}"
        out.append(" ".join(words))
    common = [f"c{i}" for i in range(60)]
    for k in range(80):
        own = [f"d{k}x{i}" for i in range(60)]
        out += [" ".join(common + own), " ".join(common + own[:-1] + [f"e{k}"])]
    for k in range(40):
        out += [f"a b c d e f g h i j k{k} l", "a b c d e f g h " + f"m{k}", f"n{k} short", ""]
    out.append(" ".join(f"long{i}" for i in range(20_000)))
    out.append(out[-1] + " more")
    return out


@pytest.mark.parametrize("split", [3, 40, 10**6])
def test_all_links_are_found(spark, texts, split):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, split=split).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts)


def test_no_bucket_is_larger_than_its_bound(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = simhash._sets(frame, 5, 6, []).selectExpr("*", "xxhash64(n, whole) AS node")
    sizes = [r["count"] for r in simhash._deal(prints, 6, 40).groupBy("bucket").count().collect()]
    assert max(sizes) < 80
    whole = [r["count"] for r in simhash._deal(prints, 6, 10**6).groupBy("bucket").count().collect()]
    assert max(whole) > 140

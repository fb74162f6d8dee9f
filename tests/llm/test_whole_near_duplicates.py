"""Near duplicates of large texts and of texts with repeated shingles."""

from sondage.llm import simhash


def same(spark, pairs):
    """For each pair of texts, whether they are of one group."""
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    return [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]


def pair(name, common, own):
    """Texts of common + own five-word shingles each, of which `common` are shared."""
    start = [f"{name}c{i}" for i in range(common + 4)]
    return tuple(" ".join(start + [f"{name}{k}{i}" for i in range(own)]) for k in "ab")


def test_large_sets_are_compared_as_a_whole(spark):
    near = [pair(f"n{i}", 966, 117) for i in range(12)]  # 966 of 1200
    far = [pair(f"f{i}", 948, 126) for i in range(12)]  # 948 of 1200
    assert same(spark, near + far) == [True] * 12 + [False] * 12


def test_repeated_shingles_count_once(spark):
    pairs = []
    for i in range(12):
        body, footer = " ".join(f"b{i}w{j}" for j in range(300)), " ".join(f"f{i}w{j}" for j in range(8))
        pairs.append(tuple(" ".join([body] + [footer] * k) for k in (2, 60)))
    assert same(spark, pairs) == [True] * 12


def test_small_sets_at_the_limit(spark):
    pairs = []
    for i in range(1500):
        words = [f"s{i}w{j}" for j in range(9)]
        pairs.append((" ".join(words), " ".join(words[:8])))
    assert same(spark, pairs) == [True] * 1500


def test_keys_find_sets_at_the_limit(spark):
    pairs = [pair(f"k{i}", 80, 10) for i in range(1500)]
    assert same(spark, pairs) == [True] * 1500

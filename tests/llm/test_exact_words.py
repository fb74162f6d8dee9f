"""Words that simple hashes confuse, and texts of equal words."""

import time

from sondage.llm import decontam, substring_dedup


def thue_morse(n):
    """Two words of n letters that polynomials of any odd base take for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_compared_not_sums(spark):
    for n in (1024, 2048, 4096):
        one, other = thue_morse(n)
        tail = " ".join(f"w{i}" for i in range(12))
        docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
        assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs).collect()} == {1: 0, 2: 0, 3: 13}
        bench = spark.createDataFrame([(1, one), (2, f"{one} {tail}")], "item_id long, text string")
        found = {r["doc_id"]: list(r["hit_items"]) for r in decontam.hits(docs, bench).collect()}
        # of item 2 the windows of ten words behind the first word occur in all
        assert found == {1: ["1", "2"], 2: ["2"], 3: ["1", "2"]}


def test_equal_words_take_linear_time(spark):
    items = [(1, "x " * 40), (2, "x " * 4000), (3, "x x x"), (4, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 50000), (2, "y x x y"), (3, "y")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], len(r["hit_words"]), list(r["hit_items"])) for r in decontam.hits(docs, bench).collect()}
    assert got == {1: (50000, 50000, ["1", "2", "3", "4"]), 2: (4, 2, ["4"]), 3: (1, 0, [])}
    assert time.time() - began < 20


def test_long_items_are_cut_without_loss(spark):
    words = [f"t{i}" for i in range(300)]
    bench = spark.createDataFrame([(7, " ".join(words)), (8, "short one")], "item_id long, text string")
    rows = [(i, f"a {' '.join(words[i : i + 10])} b") for i in range(291)] + [(900, " ".join(words)), (901, "a short one b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for limit in (1 << 20, 400):
        got = {r["doc_id"]: (len(r["hit_words"]), list(r["hit_items"])) for r in decontam.hits(docs, bench, max_bytes=limit).collect()}
        assert got == {i: (10, ["7"]) for i in range(291)} | {900: (300, ["7"]), 901: (2, ["8"])}


def test_rows_without_doc_id_are_dealt_by_text(spark, tmp_path):
    rows = [(None, f"{' '.join(f'p{i}' for i in range(20))} {k}") for k in range(40)] + [(5, " ".join(f"p{i}" for i in range(20)))]
    out = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_removed"] for r in out)) == [0] + [20] * 40
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0

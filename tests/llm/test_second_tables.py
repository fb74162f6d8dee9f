"""Second tables that are empty or say nothing, and searches that must return whole answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sondage.llm import ann, decontam

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "s", len(words)), (2, "only a few words", "en", "s", 16), (3, None, None, None, None), (4, "", "en", "s", 0), (4, "", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(2)


@pytest.mark.parametrize("items", [[], [(1, None), (2, ""), (None, "...")]])
def test_no_document_goes_with_a_benchmark_without_words(spark, docs, items, tmp_path):
    bench = spark.createDataFrame(items, ITEMS)
    found = decontam.hits(docs, bench).collect()
    assert len(found) == 5 and {(r["doc_id"], r["n_words"], len(r["hit_words"]), len(r["hit_items"])) for r in found} == {(1, 40, 0, 0), (2, 4, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0)}
    as_rows = lambda f: sorted(map(tuple, f.collect()), key=str)
    assert as_rows(decontam.remove_hits(docs, bench)) == as_rows(docs)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert as_rows(pipeline.remove_benchmark(spark, docs, str(tmp_path))) == as_rows(docs)


def test_items_without_id_count_as_one(spark, docs):
    passage = " ".join(f"w{i}" for i in range(5, 16))
    bench = spark.createDataFrame([(None, passage), (None, passage + " w16"), (7, passage)], ITEMS)
    row = decontam.hits(docs, bench).where("doc_id = 1").first()
    assert row["hit_words"] == list(range(5, 17)) and row["hit_items"] == ["7", None]
    alone = decontam.remove_hits(docs, bench.where("item_id is null")).where("doc_id = 1").first()
    assert alone["text"].split() == [f"w{i}" for i in range(40) if not 5 <= i <= 16]


def test_parts_of_a_benchmark_are_one(spark, docs):
    rows = [(k, " ".join(f"w{i}" for i in range(k, k + 10))) for k in range(0, 31, 3)]
    bench = spark.createDataFrame(rows, ITEMS)
    one, many = (decontam.hits(docs, bench, max_bytes=size).where("doc_id = 1").first() for size in (1 << 20, 1))
    assert one == many and one["n_words"] == 40


def test_no_labels_no_loss(spark, docs):
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    for frame, n in ((plain, 5), (docs.where("text = ''"), 2), (docs.limit(0), 0)):
        assert pipeline.identify_language(spark, frame, "").count() == n


def answers(frame):
    return {r["query_id"]: r["n"] for r in frame.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_each_query_has_its_answers(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 24))[rng.integers(0, 90, 4000)] + 0.3 * rng.standard_normal((4000, 24))
    x[:25] = x[0]  # more copies of one vector than answers
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(rows, rows.where("vec_id % 20 = 0"), data_rows=500)
    assert set(answers(got).values()) == {20} and len(answers(got)) == 200
    assert got.where("rank = 20").count() == 200 and got.groupBy("query_id", "vec_id").count().where("count > 1").count() == 0
    few = rows.where("vec_id < 13")
    assert answers(ann.nearest(few, few.where("vec_id in (0, 5)"))) == {0: 12, 5: 12}


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    got = ann.op9_ann(spark, folder)
    assert set(answers(got).values()) == {20} and got.count() == 20 * spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 20 = 0").count()

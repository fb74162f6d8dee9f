"""Queries of fields over whole tables and whole texts, held against brute force."""

import hashlib
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from sondage.functions import boxes
from sondage.plans import views
from sondage.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def texts(spark, extra=()):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows] + list(extra)


def folder_of(spark, tmp_path, documents):
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("customer", "part"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_strip_accents_has_every_document(spark, tmp_path):
    rows = texts(spark, [(900001, "Straße, Größe"), (900002, None), (900003, "")])
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).upper()
    want = sorted((d, t if t is None else hashlib.md5(plain(t).encode()).hexdigest()) for d, t in rows)
    got = sorted(tuple(r) for r in QUERIES["strip_accents"](spark, folder_of(spark, tmp_path, rows)).collect())
    assert any("ß" in (t or "") for _, t in rows) and got == want


def name_like(text):
    if text is None:
        return None
    words = [w for w in text.split() if any(unicodedata.category(c)[0] == "L" for c in w)]
    return len(words) >= 2 and all(len(w) >= 2 for w in words) and not any(unicodedata.category(c) == "Nd" for c in text)


def test_name_like_reads_whole_texts(spark, tmp_path):
    rows = texts(spark, [(900001, "long words of which none is short and then 7"), (900002, "long words of which none is short but x"), (900003, "long words whose thirtieth is x-shaped")])
    got = {r["id"]: r["v"] for r in QUERIES["name_like"](spark, folder_of(spark, tmp_path, rows)).where("kind = 's'").collect()}
    assert got == {d: name_like(t) for d, t in rows}
    assert (got[900001], got[900002], got[900003]) == (False, False, True)


def test_mode_label_counts_whole_labels(spark):
    counts = {}
    for r in views.boxes(spark, FOLDER).select("doc", "texto").collect():
        own = counts.setdefault(r["doc"], Counter())
        own[r["texto"]] += 1
    want = {d: min((-n, t) for t, n in c.items()) for d, c in counts.items()}
    got = {r["doc"]: (-r["n"], r["texto"]) for r in QUERIES["mode_label"](spark, FOLDER).collect()}
    assert got == want and max(len(t) for _, t in got.values()) > 6


def test_lines_of_boxes(spark):
    """Lines that are no boxes cost no failed casts; what counts as a whole number is what the cast takes."""
    lines = {"1,2,3,4,a, b": (1, 2, 3, 4, "a, b"), " +1 ,\t-2,3\r,04, t ": (1, -2, 3, 4, "t"), "1,2,3,4,": (1, 2, 3, 4, ""), "2147483647,0,0,0,m": (2147483647, 0, 0, 0, "m")}
    bad = ["", "  ", "x,y,w,h,texto", "X,y,w,h,texto", "1.5,2,3,4,t", "1,2,3,4", "2147483648,0,0,0,m", "1,,3,4,t", "1e3,2,3,4,t", "- 1,2,3,4,t", "١,2,3,4,t", None]
    frame = spark.createDataFrame([(x,) for x in [*lines, *bad]], "line string").select("line", boxes.parse(F.col("line")).alias("b"))
    assert {r["line"]: r["b"] and tuple(r["b"]) for r in frame.collect()} == lines | dict.fromkeys(bad)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("RLIKE") == plan.count("try_cast") == 4


def test_documents_read_their_boxes_few_times(spark):
    """Votes, scores and numbers of boxes come from small checkpoints, labels of all keywords from one pass, and texts are judged once a pass."""
    plan = QUERIES["load_documents"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line and "l_orderkey" in line]
    assert len(scans) == 3 and plan.count("THEN registro") == 2

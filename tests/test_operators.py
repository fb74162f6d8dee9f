"""Operators on small tables, with properties of their results."""

import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.functions import boxes, display, fields, privacy
from sondage.operators import anomaly, auc, evaluation, grouping, merge, pairing
from sondage.sources import files, sinks
from sondage.streaming import runs

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-5, 5)), min_size=2, max_size=60))
def test_auc_properties(spark, pairs):
    rows = spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, score double")
    got = auc.auc(rows).collect()
    if len({y for y, _ in pairs}) < 2:
        assert got == []
        return
    value = got[0]["auc"]
    assert value == pytest.approx(brute_auc(pairs))
    assert one(auc.auc(rows.withColumn("score", F.exp("score") * 3)))["auc"] == pytest.approx(value)
    assert one(auc.auc(rows.withColumn("y", 1 - F.col("y"))))["auc"] == pytest.approx(1 - value)


def test_auc_many_scores(spark):
    rng = random.Random(1)
    pairs = [(int(rng.random() < 0.3), rng.randint(0, 900)) for _ in range(3000)]
    rows = spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, score double")
    assert one(auc.auc(rows))["auc"] == pytest.approx(brute_auc(pairs))


def test_auc_ignores_missing(spark):
    rows = spark.createDataFrame([(1, 2.0), (0, 1.0), (1, None), (None, 3.0), (0, float("nan"))], "y int, score double")
    got = one(auc.auc(rows))
    assert (got["n_pos"], got["n_neg"], got["auc"]) == (1, 1, 1.0)


def test_balanced_source_tells_nothing(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], int(i % 7 < (2 if i % 2 else 4))) for i in range(200)] + [(900, "c", 1)], "id long, fonte string, y int")
    even = evaluation.balance_by_source(rows, "id")
    counts = {(r["fonte"], r["y"]): r["count"] for r in even.groupBy("fonte", "y").count().collect()}
    assert counts[("a", 0)] == counts[("a", 1)] and counts[("b", 0)] == counts[("b", 1)] and ("c", 1) not in counts
    assert one(evaluation.auc_source_only(even))["auc"] == pytest.approx(0.5)
    assert one(evaluation.auc_source_only(rows.where("fonte = 'a'")))["auc"] is None
    single = rows.where("y = 1")
    assert evaluation.balance_by_source(single, "id").count() == single.count()


def test_no_group_in_two_folds(spark):
    rows = spark.range(500).select((F.col("id") % 37).alias("g"))
    got = one(evaluation.leak_check(evaluation.group_kfold(rows, "g"), "g"))
    assert (got["n_groups"], got["n_leaks"]) == (37, 0)


def test_held_out_respects_sources(spark):
    rows = spark.createDataFrame([("a", 1, "t", 3.0), ("a", 0, None, 2.0), ("b", 0, None, 9.0), ("b", 1, "u", 5.0), ("b", 1, "", 1.0)], "fonte string, y int, tecnica string, score double")
    got = {r["tecnica"]: r["auc"] for r in auc.auc_of_held_out(rows, "tecnica").collect()}
    assert got == {"t": 1.0, "u": 0.0}
    both = {r["tecnica"]: r["auc"] for r in auc.auc_of_held_out(rows, "tecnica", same_source=False).collect()}
    assert both == {"t": 0.5, "u": 0.5}


def test_logistic_fit_falls(spark):
    rows = spark.createDataFrame([([float(i % 5), float(i % 3)], int(i % 5 > 2)) for i in range(60)], "v array<double>, y int")
    _, loss = evaluation.fit_logistic(rows, "v")
    assert loss[-1] < loss[0]


@pytest.mark.parametrize(("text", "good"), [("111.444.777-35", True), ("111.111.111-11", False), ("123456", False), ("111.444.777-36", False), ("", False)])
def test_cpf(spark, text, good):
    assert one(spark.createDataFrame([(text,)], "t string").select(fields.valid_cpf(F.col("t")).alias("v")))["v"] is good


def test_check_digits_always_valid(spark):
    rows = spark.range(1, 300).select(fields.with_check_digits(F.lpad((F.col("id") * 7919).cast("string"), 9, "0")).alias("t"))
    assert rows.where(~fields.valid_cpf(F.col("t"))).count() == 0
    assert one(spark.createDataFrame([("123.456.789-09",)], "t string").select(fields.digits_only(F.col("t")).alias("v")))["v"] == "12345678909"


def test_privacy(spark):
    path = "C:\\docs\\fulano.jpg"
    row = spark.createDataFrame([(path, "nome__edicao_campos_nome.png", "plain")], "p string, n string, s string").select(
        privacy.sanitize_value(F.col("p")).alias("p"),
        privacy.sanitize_file_name(F.col("n"), F.lit("deadbeef")).alias("n"),
        privacy.sanitize_value(F.col("s")).alias("s"),
        privacy.sanitize_value(privacy.sanitize_value(F.col("p"))).alias("twice"),
        privacy.drop_sensitive(F.create_map(F.lit("texto_original"), F.lit("x"), F.lit("k"), F.lit("v"))).alias("m"),
        privacy.sanitize_json(F.lit(json.dumps({"a": [path, {"b": path}], "caixa": [1, 2], "conf": 0.5, "valor": "x"}))).alias("j"),
        privacy.sanitize_json(F.lit("{")).alias("bad"),
    )
    got = one(row)
    assert len(got["p"]) == 16 and "fulano" not in str(got) and got["twice"] == got["p"]
    assert got["n"] == "deadbeef__edicao_campos_nome.png" and got["s"] == "plain" and got["m"] == {"k": "v"} and got["bad"] is None
    clean = json.loads(got["j"])
    assert clean == {"a": [got["p"], {"b": got["p"]}], "caixa": [1, 2], "conf": 0.5, "valor": "x"}


@pytest.mark.parametrize(("text", "share"), [("AB1", 1.0), ("ABX", 2 / 3), ("ab1", 1.0), ("", 0.0), ("  ", 0.0)])
def test_char_coverage(spark, text, share):
    got = one(spark.createDataFrame([(text,)], "t string").select(fields.char_coverage(F.col("t"), F.array(*map(F.lit, "AB1"))).alias("v")))
    assert got["v"] == pytest.approx(share)


def test_fields(spark):
    row = spark.createDataFrame([("Filiação", "Maria de Souza", "A Souza", "Joao 2")], "a string, b string, c string, d string")
    got = one(row.select(fields.is_label(F.col("a")).alias("a"), fields.name_like(F.col("b")).alias("b"), fields.name_like(F.col("c")).alias("c"), fields.name_like(F.col("d")).alias("d"), fields.strip_accents(F.col("a")).alias("s"), fields.strip_accents_nfkd(F.col("a")).alias("k")))
    assert (got["a"], got["b"], got["c"], got["d"], got["s"], got["k"]) == (True, True, False, False, "FILIACAO", "FILIACAO")


@FEW
@given(st.integers(0, 90), st.integers(0, 90), st.integers(1, 40), st.integers(1, 40))
def test_rotations(spark, x, y, w, h):
    row = spark.createDataFrame([(x, y, w, h)], "x int, y int, w int, h int").select(F.struct("x", "y", "w", "h").alias("b"))
    quarter = row.select(boxes.rotate(F.col("b"), F.lit(200), F.lit(150), F.lit(90)).alias("b"))
    back = one(quarter.select(boxes.rotate(F.col("b"), F.lit(150), F.lit(200), F.lit(270)).alias("b")))["b"]
    assert (back["w"], back["h"]) == (w, h) and abs(back["x"] - x) <= 1 and abs(back["y"] - y) <= 1
    inside = one(row.select(boxes.clamp(F.col("b"), F.lit(50), F.lit(50)).alias("b")))["b"]
    assert inside["w"] >= 0 and inside["h"] >= 0


def test_box_lines(spark):
    lines = ["1,2,3,4,a,b", "x,y,w,h,text", "", "1,2,3", "1,2,c,4,t"]
    rows = spark.createDataFrame([(v,) for v in lines], "v string").select(boxes.parse(F.col("v")).alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in rows] == [(1, 2, 3, 4, "a,b"), None, None, None, None]


def test_labels_and_values(spark):
    words = [(1, 0, 1, 1, 0, 0, 10, 5, "NOME"), (1, 1, 1, 1, 20, 1, 10, 9, "Ana"), (1, 2, 1, 2, 0, 10, 30, 5, "Bea"), (1, 3, 1, 3, 0, 20, 10, 5, " "), (1, 4, 1, 4, 0, 30, 9, 5, "Cia")]
    rows = spark.createDataFrame(words, "doc int, id int, block int, line int, x int, y int, w int, h int, texto string")
    got = {(r["kind"], r["x"], r["y"], r["w"], r["h"]) for r in pairing.values_of_labels(rows, F.col("texto") == "NOME", "doc", "id").collect()}
    assert got == {(0, 20, 0, 10, 10), (1, 0, 10, 30, 5)}


def test_merge(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("", 1, "z")], "id string, seq int, v string")
    new = spark.createDataFrame([("a", 1, "x2"), ("a", 2, "x3"), ("c", 1, None)], "id string, seq int, v string")
    got = {r["id"]: r["v"] for r in merge.upsert(old, new, ["id"], ["seq"]).collect()}
    assert got == {"a": "x3", "b": "y", "c": None}
    again = merge.upsert(merge.upsert(old, new, ["id"], ["seq"]), new, ["id"], ["seq"])
    assert {r["id"]: r["v"] for r in again.collect()} == got
    log = spark.createDataFrame([("r", 1, 5, None), ("r", 2, None, 7), ("r", 3, 6, None)], "run string, seq int, a int, b int")
    assert tuple(one(merge.field_merge(log, ["run"], ["seq"], ["a", "b"]))) == ("r", 6, 7)
    assert merge.assert_unique(old, ["id"]).count() == 0


def test_patches(spark):
    flat = spark.createDataFrame([(0, i, j, [1.0, 0.0]) for i in range(3) for j in range(3)], "img long, i int, j int, v array<double>")
    assert {round(r["dev"], 9) for r in anomaly.local_deviation(flat, 3).collect()} == {0.0}
    odd = flat.withColumn("v", F.when((F.col("i") == 1) & (F.col("j") == 1), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.col("v")))
    got = {(r["i"], r["j"]): r["dev"] for r in anomaly.local_deviation(odd, 3).collect()}
    assert max(got, key=got.get) == (1, 1) and got[(1, 1)] == pytest.approx(1.0)
    with pytest.raises(Exception, match="no full grid"):
        anomaly.anomaly_vector(flat.where("i < 2"), 3).collect()


def test_display(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (0.9,)], "v double").select(display.format_auc(F.col("v")).alias("f"), display.band(F.col("v"))["variante"].alias("b"), display.gauge_position(F.col("v")).alias("g")).collect()
    assert [(r["f"], r["b"]) for r in rows] == [("—", "info"), ("—", "info"), ("0,500", "ok"), ("0,900", "bad")]
    assert rows[0]["g"] == 0 and math.isclose(rows[3]["g"], 80)


def test_files(spark, tmp_path):
    folder = tmp_path / "reais_fraude" / "troca_foto"
    folder.mkdir(parents=True)
    (folder / "a.manifesto.json").write_text(json.dumps({"id": "1", "tecnica": "troca_foto", "parametros": {"modo": "x", "lista": [1, {"y": 2}]}, "extra": 1}, indent=1))
    (folder / "b.manifesto.json").write_text("{broken")
    (folder / "c.manifesto.json").write_text(json.dumps({"tecnica": "sem id"}))
    got = one(files.manifests(spark, str(tmp_path)))
    assert (got["id"], got["rotulo"], got["fonte_dados"]) == ("1", None, "reais")
    (tmp_path / "log.jsonl").write_text('{"run_id": "r", "ts": 1.5, "tipo": "epoca", "epoca": 1}\nnot json\n{"tipo": "fim"}\n')
    assert files.events(spark, str(tmp_path / "log.jsonl")).count() == 2
    (tmp_path / "doc_gt_ocr.txt").write_text("x,y,w,h,text\n1,2,3,4,Ana, Bea\n")
    assert one(files.boxes_of(spark, str(tmp_path / "doc_gt_ocr.txt")))["texto"] == "Ana, Bea"
    out = str(tmp_path / "out")
    sinks.append_events(spark.createDataFrame([("epoca", 1)], "tipo string, epoca int"), out, "r1")
    sinks.append_events(spark.createDataFrame([("own", "fim")], "run_id string, tipo string"), out, "r1")
    assert {r["run_id"] for r in files.events(spark, out).collect()} == {"r1", "own"}


def test_stream_equals_batch(spark, tmp_path):
    events = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, ["inicio", "epoca", "epoca", "outro"][(i * 7) % 4], i) for i in range(40)]
    frame = spark.createDataFrame(events, "event_id long, ts string, run long, tipo string, epoca int").withColumn("ts", F.to_timestamp("ts"))
    frame.where("event_id < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    frame.where("event_id >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder = runs.work_folder(spark)
    live = runs.fold_runs(runs.read(spark, str(tmp_path / "in"), frame, 8), folder)
    batch = grouping.run_state(frame, "run", "tipo", ["ts", "event_id"], "epoca")
    key = lambda r: (r["run"], r["starts"], r["n_epochs"], r["epochs"])
    assert sorted(map(key, live.collect())) == sorted(map(key, batch.collect()))

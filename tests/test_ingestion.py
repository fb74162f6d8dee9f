"""Ingestion from files, donors, image indexes, encodings, the trained protocols, history and tail."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import auc, evaluation, ingest, pairing, protocols
from sondage.sources import files, sinks
from sondage.streaming import runs


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


REAL = {
    "id": "r1", "tecnica": "troca_foto", "documento_origem": "acervo\\cartorio\\pasta 7\\Escritura antiga.jpeg", "tipo_documento": "rg",
    "arquivo_gerado": "Escritura antiga__lote9_3.png", "rotulo": "fraude", "gerador": "x",
    "parametros": {"passo": 4, "vizinho": "acervo/cartorio/folha solta.jpeg", "texto_original": "Beltrana", "partes": [{"de": "a\\b", "n": 1}, 0.5]},
}
BID = {"id": "b1", "tecnica": "edicao_campos", "documento_origem": "gerados/lote2/17.jpg", "arquivo_gerado": "17__cor.png", "parametros": {"texto_original": "TEXTO INVENTADO", "semente": 17}}


def put(folder, manifest, name):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.manifesto.json").write_text(json.dumps(manifest, indent=1))


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "in/reais_fraude/troca_foto", REAL, "a")
    put(tmp_path / "in/bid_fraude/edicao", BID, "b")
    put(tmp_path / "in/elsewhere", BID | {"id": "other"}, "c")
    put(tmp_path / "in/bid_legitimos", {"id": "l1", "rotulo": "legitimo"}, "d")
    return tmp_path


def test_ingest_end_to_end(spark, root):
    table = str(root / "amostras")
    assert sinks.read_table(spark, table) is None
    assert tuple(ingest.ingest_samples(spark, str(root / "in"), table).first()) == (3, 0, 0)
    rows = {r["id"]: r for r in sinks.read_table(spark, table).withColumns({c: F.to_json(c) for c in ("parametros", "parametros_captura")}).collect()}
    assert set(rows) == {"r1", "b1", "l1"} and len(rows["r1"]) == 15
    real = rows["r1"]
    document = digest(REAL["documento_origem"])
    assert (real["documento_id"], real["arquivo"], real["fonte_dados"]) == (document, f"{document}__lote9_3.png", "reais")
    assert json.loads(real["parametros"]) == {"passo": 4, "vizinho": digest(REAL["parametros"]["vizinho"]), "partes": [{"de": digest("a\\b"), "n": 1}, 0.5]}
    assert not any(word in str(real) for word in ("Escritura", "cartorio", ".jpeg", "Beltrana"))
    assert json.loads(rows["b1"]["parametros"]) == BID["parametros"] and rows["b1"]["arquivo"] == "17__cor.png" and rows["b1"]["rotulo"] == "fraude"
    assert (rows["l1"]["rotulo"], rows["l1"]["parametros"], rows["l1"]["parametros_captura"], rows["l1"]["arquivo"]) == ("legitimo", "{}", "{}", "")
    put(root / "in/bid_fraude/edicao", BID | {"dificuldade": "media"}, "b")
    put(root / "in/bid_fraude/edicao", BID | {"id": "b2"}, "e")
    assert tuple(ingest.ingest_samples(spark, str(root / "in"), table).first()) == (1, 1, 2)
    again = sinks.read_table(spark, table)
    assert again.count() == 4 and again.where("id = 'b1'").first()["dificuldade"] == "media"


def test_events_merge_by_field(spark, tmp_path):
    kind = "run_id string, ts double, tipo string, epoca int, loss_val double, auc_val double"
    first = spark.createDataFrame([("r", 1.0, "epoca", 1, 0.5, None), ("r", 2.0, "epoca", 2, 0.4, 0.7), ("r", 3.0, "estado_gerador", None, None, None), ("r", 4.0, "fim", None, None, None)], kind)
    later = spark.createDataFrame([("r", 5.0, "epoca", 1, None, 0.6)], kind)
    to = [str(tmp_path / x) for x in ("m", "a")]
    assert [tuple(x.first()) for x in ingest.ingest_events(first, *to)] == [(2, 0, 0), (1, 0, 0)]
    assert tuple(ingest.ingest_events(later, *to)[0].first()) == (0, 1, 0)
    got = {r["epoca"]: (r["loss_val"], r["auc_val"]) for r in sinks.read_table(spark, to[0]).collect()}
    assert got == {1: (0.5, 0.6), 2: (0.4, 0.7)}


@pytest.mark.parametrize("quota", [1, 5, 30])
def test_donors(spark, quota):
    kinds = {i: "a" for i in range(7)} | {7: "b", 8: "b", 9: "c"}
    rows = spark.createDataFrame(list(kinds.items()), "id long, kind string")
    got = {}
    for r in pairing.donors(rows, "id", "kind", quota).orderBy("target", "place").collect():
        got.setdefault(r["target"], []).append(r["donor"])
    assert set(got) == set(kinds)
    for t, donors in got.items():
        others = [i for i, k in kinds.items() if i != t and (k == kinds[t] or kinds[t] == "c")]
        assert len(donors) == (min(quota, 21) if len(others) == 1 else quota) and set(donors) <= set(others)
        assert len(set(donors)) == min(len(others), len(donors))
    assert pairing.donors(rows.where("id = 9"), "id", "kind", quota).count() == 0


def test_image_index(spark, root):
    for name in ("in/reais_fraude/troca_foto/a", "in/bid_legitimos/x__1", "in/bid_fraude/rabisco/z"):
        (root / f"{name}.png").parent.mkdir(parents=True, exist_ok=True)
        (root / f"{name}.png").write_bytes(b"x")
    got = [(r["caminho"].rsplit("/", 1)[1], r["rotulo"], r["tecnica"], r["fonte"], r["gerador"]) for r in files.sample_index(spark, str(root / "in")).collect()]
    assert sorted(got) == [("a.png", 1, "troca_foto", "reais", "x"), ("x__1.png", 0, "bid_legitimos", "bid", ""), ("z.png", 1, "rabisco", "bid", "")]
    assert {(r["y"], r["tecnica"]) for r in files.images(spark, str(root / "in/bid_legitimos"), 0).collect()} == {(0, "legitimo")}


@pytest.mark.parametrize(("mark", "raw", "text"), [(b"\xef\xbb\xbf", "José".encode(), "José"), (b"", "José €".encode("cp1252"), "José €"), (b"", b"Jos\xe9 \x81 \x80", "José \x81 \x80")])
def test_annotation_encodings(spark, tmp_path, mark, raw, text):
    (tmp_path / "d_gt_ocr.txt").write_bytes(mark + b"1,2,3,4," + raw + b"\r\n\r\nx,y,w,h,t\r\n1,2,3,a,t")
    assert [r["texto"] for r in files.boxes_of(spark, str(tmp_path)).collect()] == [text]


def newton(x, y, c=1.0):
    """Logistic regression with a summed loss and a penalty on all weights but the first."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    a = np.column_stack((np.ones(len(x)), (x - mean) / sd))
    w, keep = np.zeros(a.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a.T * (p * (1 - p))) @ a + keep, a.T @ (p - y) + keep @ w)
    return lambda z: np.column_stack((np.ones(len(z)), (z - mean) / sd)) @ w


def brute_auc(s, y):
    p, n = s[y == 1], s[y == 0]
    return float(((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean())


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        y, source = int(rng.random() < 0.4), "ab"[i % 2]
        x = rng.standard_normal(6) + 0.8 * y + 0.3 * (source == "b")
        rows.append((i, i // 3, source, f"t{rng.integers(0, 3)}" if y else None, f"g{i % 2}" if y else "", y, x.tolist()))
    return spark.createDataFrame(rows, "key long, grupo long, fonte string, tecnica string, gerador string, y int, v array<double>").cache()


def test_protocols_against_newton(spark, samples):
    rows = samples.toPandas()
    x, y = np.array(rows["v"].tolist()), rows["y"].to_numpy()
    for same in (True, False):
        got = {r["tecnica"]: (r["n_pos"], r["n_neg"], r["auc"]) for r in protocols.held_out(samples, "v", "tecnica", same).collect()}
        for t in ("t0", "t1", "t2"):
            held = ((rows["tecnica"] == t) & (y == 1)).to_numpy()
            against = (y == 0) & (rows["fonte"].isin(set(rows["fonte"][held])).to_numpy() if same else True)
            test = held | against
            want = brute_auc(newton(x[~held], y[~held])(x[test]), y[test])
            assert got[t][:2] == (held.sum(), against.sum()) and got[t][2] == pytest.approx(want, abs=2e-3)
    folds = {r["key"]: r["fold"] for r in evaluation.stratified_group_kfold(samples, "grupo").collect()}
    fold = rows["key"].map(folds).to_numpy()
    for r in protocols.grouped_cv(samples, "v", "grupo").collect():
        test = fold == r["fold"]
        assert r["auc"] == pytest.approx(brute_auc(newton(x[~test], y[~test])(x[test]), y[test]), abs=2e-3)
    assert protocols.held_out(samples, "v", "gerador", least_keys=3).count() == 0


def test_folds_are_stratified(spark, samples):
    per = evaluation.stratified_group_kfold(samples, "grupo").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p")).collect()
    assert len(per) == 5 and max(r["n"] for r in per) <= 2 * min(r["n"] for r in per)
    assert max(abs(r["p"] - 0.4) for r in per) < 0.2
    assert evaluation.leak_check(evaluation.stratified_group_kfold(samples, "grupo"), "grupo").first()["n_leaks"] == 0


def test_training_events(spark, samples, tmp_path):
    events = protocols.training_events(samples, "v", "key", "grupo", "run7", epochs=25, hidden=16, rate=0.01)
    rows = events.collect()
    kinds = [r["tipo"] for r in rows]
    assert kinds == ["inicio", "estado_gerador", *["epoca"] * 25, "fim"]
    epochs = rows[2:-1]
    assert epochs[-1]["loss_treino"] < epochs[0]["loss_treino"] and [r["epoca"] for r in epochs] == list(range(1, 26))
    assert all(r["loss_val"] > 0 and 0 <= r["auc_val"] <= 1 and set(r["auc_por_tecnica"]) <= {"t0", "t1", "t2"} and r["auc_por_tecnica"] for r in epochs)
    state = rows[1]
    assert set(state["loto"]) == {"t0", "t1", "t2"} and set(state["logo"]) == {"g0", "g1"} and sum(state["por_tecnica"].values()) == state["n_fraude"] == state["n_legitimo"]
    assert 0.5 < state["auc_agrupada"] <= 1 and rows[0]["n_treino"] > rows[0]["n_val"]
    to = str(tmp_path / "log")
    sinks.append_events(events, to, "run7")
    assert files.events(spark, to).count() == len(rows)


def test_history_and_tail(spark, tmp_path):
    def write(low, high):
        spark.range(low, high).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write(0, 5)
    like = spark.read.parquet(str(tmp_path / "in"))
    history, more = runs.snapshot_and_tail(runs.read(spark, str(tmp_path / "in"), like), runs.work_folder(spark))
    ids = lambda f: sorted(r["event_id"] for r in f.collect())
    assert ids(history) == [0, 1, 2, 3, 4] and ids(more()) == []
    write(5, 8)
    assert ids(more()) == [5, 6, 7] and ids(more()) == []
    assert runs.once(spark.readStream.schema(like.schema).parquet(str(tmp_path / "in")), "event_id").isStreaming


def test_auc_of_no_rows(spark, samples):
    assert auc.auc(samples.limit(0).withColumn("score", F.lit(0.0))).count() == 0

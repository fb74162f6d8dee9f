"""Queries of the evaluation protocols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import auc as A
from ..operators import evaluation as ev
from ..operators import grouping, protocols
from . import views
from .registry import D, E, L, auc, balanced, fold, held_auc, held_hist, hist, query, r6


def _auc(rows, by=()):
    return A.auc(rows, by).withColumn("auc", r6("auc"))


@query("auc_exact", f"WITH {D}, h AS ({hist('D')}) {auc('h')}")
def auc_exact(spark, d):
    return _auc(views.texts(spark, d))


@query("auc_by_group", f"WITH {L}, h AS ({hist('L', 'fonte')}) {auc('h', 'fonte')}")
def auc_by_group(spark, d):
    return _auc(views.samples(spark, d), ("fonte",))


@query("auc_by_technique", f"WITH {L} {auc(held_hist('tecnica'), 'tecnica')}")
def auc_by_technique(spark, d):
    return A.auc_of_held_out(views.samples(spark, d), "tecnica").withColumn("auc", r6("auc"))


_SOURCE_ONLY = """r AS (SELECT fonte, sum(y) AS p, count(*) AS c FROM {0} GROUP BY fonte), rh AS (SELECT p / c AS score, sum(p) AS p, sum(c - p) AS n FROM r GROUP BY 1)"""


@query("auc_source_only", f"WITH {D}, {_SOURCE_ONLY.format('D')} SELECT (SELECT count(*) FROM r) AS n_sources, (SELECT auc FROM ({auc('rh')})) AS auc")
def auc_source_only(spark, d):
    return ev.auc_source_only(views.texts(spark, d)).withColumn("auc", r6("auc"))


@query("balance_by_source", f"WITH {D} SELECT doc_id, fonte, y FROM ({balanced('D', 'doc_id')})")
def balance_by_source(spark, d):
    return ev.balance_by_source(views.texts(spark, d), "doc_id").select("doc_id", "fonte", "y")


@query("group_kfold", f"WITH {L} SELECT documento_id, {fold('documento_id')} AS fold, count(*) AS n FROM L GROUP BY documento_id")
def group_kfold(spark, d):
    return ev.group_kfold(views.samples(spark, d), "documento_id").groupBy("documento_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("kfold_leak_check", f"WITH {L} SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS n_leaks FROM (SELECT documento_id, count(DISTINCT {fold('documento_id')}) AS n FROM L GROUP BY documento_id)")
def kfold_leak_check(spark, d):
    return ev.leak_check(ev.group_kfold(views.samples(spark, d), "documento_id"), "documento_id")


@query("kfold_summary", f"WITH {L}, f AS (SELECT *, {fold('documento_id')} AS fold FROM L), h AS ({hist('f', 'fold')}) SELECT count(*) AS n_folds, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM ({auc('h', 'fold', None)})")
def kfold_summary(spark, d):
    out = ev.fold_summary(ev.group_kfold(views.samples(spark, d), "documento_id"))
    return out.select("n_folds", r6("mean_auc").alias("mean_auc"), r6("std_auc").alias("std_auc"))


def _centroid_sql(label: str) -> str:
    return f"""WITH {E}, f AS (SELECT vec_id, v, {label} AS y, {fold('grupo')} AS fold FROM E),
      c AS (SELECT fold, y, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM f),
      m AS (SELECT h.fold, c.i, avg(c.x) FILTER (c.y = 1) - avg(c.x) FILTER (c.y = 0) AS d FROM (SELECT DISTINCT fold FROM f) h JOIN c ON c.fold <> h.fold GROUP BY h.fold, c.i),
      l AS (SELECT fold, list(d ORDER BY i) AS line FROM m GROUP BY fold),
      s AS (SELECT f.fold, f.y, list_inner_product(f.v, l.line) AS score FROM f JOIN l ON f.fold = l.fold),
      h AS ({hist('s', 'fold')}) """


@query("cv_centroid_auc", _centroid_sql("y") + auc("h", "fold", 5))
def cv_centroid_auc(spark, d):
    folded = ev.group_kfold(views.vectors(spark, d), "grupo")
    return A.auc(ev.centroid_scores(folded, "embedding"), ("fold",)).withColumn("auc", r6("auc", 5))


@query("source_separability", _centroid_sql("CASE WHEN fonte = 0 THEN 1 ELSE 0 END") + f"SELECT count(*) AS n_folds, round(avg(auc), 5) AS auc FROM ({auc('h', 'fold', None)})")
def source_separability(spark, d):
    rows = views.vectors(spark, d)
    first = rows.agg(F.min("fonte").alias("_first"))
    named = rows.crossJoin(F.broadcast(first)).withColumn("y", (F.col("fonte") == F.col("_first")).cast("int")).drop("_first")
    per = A.auc(ev.centroid_scores(ev.group_kfold(named, "grupo"), "embedding"), ("fold",))
    return per.agg(F.count(F.lit(1)).alias("n_folds"), r6(F.avg("auc"), 5).alias("auc"))


@query("loto_masks", f"""WITH {L}, k AS (SELECT tecnica, count(*) AS n_test_pos FROM L WHERE y = 1 GROUP BY tecnica),
  s AS (SELECT t.tecnica, count(*) AS n_test_neg FROM (SELECT DISTINCT tecnica, fonte FROM L WHERE y = 1) t JOIN L ON L.fonte = t.fonte AND L.y = 0 GROUP BY t.tecnica)
  SELECT k.tecnica, (SELECT count(*) FROM L) - n_test_pos AS n_train, (SELECT count(*) FROM L WHERE y = 1) - n_test_pos AS n_train_pos, n_test_pos, coalesce(n_test_neg, 0) AS n_test_neg FROM k LEFT JOIN s ON k.tecnica = s.tecnica""")
def loto_masks(spark, d):
    return ev.held_out_masks(views.samples(spark, d), "tecnica")


@query("loto_same_source", f"WITH {L} SELECT t.tecnica, t.fonte, count(*) AS n_neg FROM (SELECT DISTINCT tecnica, fonte FROM L WHERE y = 1) t JOIN L ON L.fonte = t.fonte AND L.y = 0 GROUP BY ALL")
def loto_same_source(spark, d):
    return ev.held_out_sources(views.samples(spark, d), "tecnica").select("tecnica", "fonte", "n_neg")


@query("loto_auc", f"WITH {L} {held_auc('tecnica')}")
def loto_auc(spark, d):
    return ev.held_out_auc(views.samples(spark, d), "tecnica").withColumn("auc", r6("auc")).orderBy("auc", "tecnica")


@query("loto_all_negatives", f"WITH {L} {held_auc('tecnica', False)}")
def loto_all_negatives(spark, d):
    return ev.held_out_auc(views.samples(spark, d), "tecnica", same_source=False).withColumn("auc", r6("auc")).orderBy("auc", "tecnica")


@query("logo_auc", f"WITH {L} {held_auc('gerador')}")
def logo_auc(spark, d):
    return ev.held_out_auc(views.samples(spark, d), "gerador").withColumn("auc", r6("auc")).orderBy("auc", "gerador")


_PAIRS = "string_agg({0} || '=' || {1}, ';' ORDER BY {0})"
_SIX = "printf('%.6f', auc)"


def _shown(m: str, number: bool) -> Column:
    """A map as text, its keys in order."""
    value = (lambda e: F.format_string("%.6f", e["value"])) if number else (lambda e: e["value"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), value(e))), ";").alias(m)


@query("snapshot", f"""WITH {L}, {_SOURCE_ONLY.format('L')}, bal AS ({balanced('L', 'key')}), f AS (SELECT *, {fold('documento_id')} AS fold FROM bal), h AS ({hist('f', 'fold')}),
  lo AS ({held_auc('tecnica', True, 'bal', None)}), lg AS ({held_auc('gerador', True, 'bal', None)})
  SELECT (SELECT count(*) FROM bal) AS n_amostras, (SELECT count(*) FROM bal WHERE y = 1) AS n_fraude, (SELECT count(*) FROM bal WHERE y = 0) AS n_legitimo, (SELECT count(DISTINCT fonte) FROM bal) AS n_fontes,
    (SELECT {_PAIRS.format('k', 'n')} FROM (SELECT coalesce(tecnica, '') AS k, count(*) AS n FROM bal WHERE y = 1 GROUP BY 1)) AS por_tecnica,
    (SELECT {_PAIRS.format('k', 'n')} FROM (SELECT coalesce(gerador, '') AS k, count(*) AS n FROM bal WHERE y = 1 GROUP BY 1)) AS por_gerador,
    (SELECT {_PAIRS.format('k', 'n')} FROM (SELECT fonte AS k, count(*) AS n FROM bal GROUP BY 1)) AS por_fonte,
    (SELECT auc FROM ({auc('rh')})) AS auc_fonte_sozinha, (SELECT round(avg(auc), 6) FROM ({auc('h', 'fold', None)})) AS auc_agrupada,
    (SELECT round(min(auc), 6) FROM lo) AS loto_min, (SELECT round(max(auc), 6) FROM lo) AS loto_max,
    (SELECT {_PAIRS.format('tecnica', _SIX)} FROM lo) AS loto, (SELECT {_PAIRS.format('gerador', _SIX)} FROM lg) AS logo""")
def snapshot(spark, d):
    out = ev.snapshot(views.samples(spark, d), "key", "documento_id")
    rounded = out.withColumns({c: r6(c) for c in ("auc_fonte_sozinha", "auc_agrupada", "loto_min", "loto_max")})
    return rounded.withColumns({m: _shown(m, m in ("loto", "logo")) for m in ("por_tecnica", "por_gerador", "por_fonte", "loto", "logo")})


_COST = "i.p * (2 * pos[k] + i.p) * all_n * all_n + (i.n - i.p) * (2 * neg[k] + i.n - i.p) * all_p * all_p"
_ADDED = "list_transform(range(1, 6), lambda k: CASE WHEN k = best THEN {0}[k] + {1} ELSE {0}[k] END)"


@query("stratified_kfold", f"""WITH RECURSIVE {L}, g AS (SELECT documento_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM L GROUP BY documento_id),
  sz AS (SELECT n, p, count(*) AS m FROM g GROUP BY n, p),
  item AS (SELECT n, p, place, row_number() OVER (ORDER BY n DESC, p DESC, place) AS step FROM (SELECT n, p, unnest(range(1, m % 5 + 1)) AS place FROM sz)),
  t AS (SELECT CAST(greatest(sum(p * m), 1) AS HUGEINT) AS all_p, CAST(greatest(sum((n - p) * m), 1) AS HUGEINT) AS all_n FROM sz),
  run AS (
    SELECT CAST(0 AS BIGINT) AS step, [CAST(0 AS HUGEINT), 0, 0, 0, 0] AS pos, [CAST(0 AS HUGEINT), 0, 0, 0, 0] AS neg, CAST(0 AS BIGINT) AS best
    UNION ALL
    SELECT step, {_ADDED.format('pos', 'p')}, {_ADDED.format('neg', '(n - p)')}, best FROM (
      SELECT i.step, pos, neg, CAST(i.p AS HUGEINT) AS p, CAST(i.n AS HUGEINT) AS n,
        CAST(list_position(list_transform(range(1, 6), lambda k: {_COST}), list_min(list_transform(range(1, 6), lambda k: {_COST}))) AS BIGINT) AS best
      FROM run JOIN item i ON i.step = run.step + 1, t)),
  r AS (SELECT documento_id, n, p, row_number() OVER (PARTITION BY n, p ORDER BY md5(CAST(documento_id AS VARCHAR)), documento_id) AS at FROM g)
  SELECT documento_id, CAST(coalesce(run.best - 1, r.at % 5) AS INT) AS fold, r.n
  FROM r LEFT JOIN item i ON i.n = r.n AND i.p = r.p AND i.place = r.at LEFT JOIN run ON run.step = i.step""")
def stratified_kfold(spark, d):
    return ev.stratified_group_kfold(views.samples(spark, d), "documento_id").groupBy("documento_id", "fold").agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark, d):
    return views.vectors(spark, d).withColumns({"tecnica": F.when(F.col("y") == 1, F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string"))), "gerador": F.when(F.col("y") == 1, F.concat(F.lit("g"), (F.col("vec_id") % 2).cast("string")))})


@query("cv_logistic_auc")
def cv_logistic_auc(spark, d):
    return protocols.grouped_cv(_vectors(spark, d), "embedding", "grupo")


@query("loto_logistic_auc")
def loto_logistic_auc(spark, d):
    return protocols.held_out(_vectors(spark, d), "embedding", "tecnica")


@query("logo_logistic_auc")
def logo_logistic_auc(spark, d):
    return protocols.held_out(_vectors(spark, d), "embedding", "gerador", least_keys=2)


@query("loto_logistic_all_negatives")
def loto_logistic_all_negatives(spark, d):
    return protocols.held_out(_vectors(spark, d), "embedding", "tecnica", same_source=False)


@query("training_events")
def training_events(spark, d):
    return protocols.training_events(_vectors(spark, d), "embedding", "vec_id", "grupo", "run", epochs=30)


@query("verdict_generalization", f"WITH {L} SELECT count(*) AS n_keys, round(max(auc) - min(auc), 6) AS amplitude, max(auc) - min(auc) < 0.1 AS ok FROM ({held_auc('tecnica', True, 'L', None)}) WHERE n_pos >= 20 HAVING count(*) >= 2")
def verdict_generalization(spark, d):
    return grouping.gated_range(ev.held_out_auc(views.samples(spark, d), "tecnica")).withColumn("amplitude", r6("amplitude"))


@query("counts_as_map", f"""WITH {L} SELECT (SELECT {_PAIRS.format('k', 'n')} FROM (SELECT coalesce(tecnica, '') AS k, count(*) AS n FROM L WHERE y = 1 GROUP BY 1)) AS por_tecnica,
  (SELECT {_PAIRS.format('k', 'n')} FROM (SELECT coalesce(fonte, '') AS k, count(*) AS n FROM L GROUP BY 1)) AS por_fonte""")
def counts_as_map(spark, d):
    rows = views.samples(spark, d)
    maps = ev.counts_as_map(rows.where("y = 1"), "tecnica", "por_tecnica").crossJoin(F.broadcast(ev.counts_as_map(rows, "fonte", "por_fonte")))
    return maps.select(_shown("por_tecnica", False), _shown("por_fonte", False))


@query("summary_counts", f"WITH {L} SELECT count(*) AS total, count(*) FILTER (y = 1) AS fraude, count(*) FILTER (y = 0) AS legitimo FROM L")
def summary_counts(spark, d):
    return grouping.summary(views.samples(spark, d))


@query("group_counts", f"WITH {L} SELECT tecnica, count(*) AS n FROM L WHERE y = 1 AND tecnica <> '' GROUP BY tecnica")
def group_counts(spark, d):
    return grouping.counts(views.samples(spark, d).where("y = 1"), "tecnica")


@query("distinct_docs", f"WITH {L} SELECT count(DISTINCT documento_id) AS n FROM L")
def distinct_docs(spark, d):
    return grouping.distinct_count(views.samples(spark, d), "documento_id")


@query("distinct_sorted", f"WITH {L} SELECT DISTINCT gerador FROM L WHERE y = 1 AND gerador <> ''")
def distinct_sorted(spark, d):
    return grouping.distinct_sorted(views.samples(spark, d).where("y = 1"), "gerador")


@query("share_of_max", f"WITH {L}, c AS (SELECT tecnica, count(*) AS n FROM L WHERE y = 1 GROUP BY tecnica) SELECT tecnica, n, round(100.0 * n / (SELECT max(n) FROM c), 6) AS share FROM c")
def share_of_max(spark, d):
    return grouping.share_of_max(grouping.counts(views.samples(spark, d).where("y = 1"), "tecnica")).withColumn("share", r6("share"))


@query("stratified_k", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 50")
def stratified_k(spark, d):
    from ..sources.files import table

    return grouping.stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)

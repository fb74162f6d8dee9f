"""Queries of records, merges, events, streams and vectors."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import privacy
from .. import schemas, storage
from ..operators import anomaly, grouping, ingest, merge, pairing
from ..sources import sinks
from ..sources.files import table
from ..streaming import runs
from . import views
from .registry import E, G, L, V, query, r6

ORDER = views.CHANGE_ORDER
#: The change log in SQL.
U = "U AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"
_DESC = ", ".join(f"{c} DESC" for c in ORDER)


@query("index_left_join", "SELECT d.doc_id, coalesce(CAST(l.toxic AS VARCHAR), 'pasta') AS rotulo, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def index_left_join(spark, d):
    out = pairing.sidecar(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])
    return out.select("doc_id", F.coalesce(F.col("toxic").cast("string"), F.lit("pasta")).alias("rotulo"), "quality")


@query("pair_candidates", """WITH a AS (
    SELECT s_suppkey AS target, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS at, count(*) OVER (PARTITION BY s_nationkey) AS n,
      row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS over_all, count(*) OVER () AS total, CAST('0x' || substr(md5(s_suppkey || '/'), 1, 8) AS UBIGINT) AS start FROM supplier),
  w AS (SELECT *, unnest(range(0, CASE WHEN n = 2 OR (n = 1 AND total = 2) THEN least(30, 21) ELSE 30 END)) AS place FROM a WHERE n > 1 OR total > 1)
  SELECT w.target, CAST(w.place AS INT) AS place, b.target AS donor FROM w JOIN a b ON w.n > 1 AND b.k = w.k AND b.at = (w.at + 1 + (w.start + w.place) % (w.n - 1)) % w.n
  UNION ALL SELECT w.target, CAST(w.place AS INT), b.target FROM w JOIN a b ON w.n = 1 AND b.over_all = (w.over_all + 1 + (w.start + w.place) % (w.total - 1)) % w.total""")
def pair_candidates(spark, d):
    return pairing.donors(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", 30)


@query("union_groups", "SELECT 'customer' AS grupo, c_name AS nome FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier")
def union_groups(spark, d):
    return grouping.union_groups({"customer": table(spark, d, "customer").select(F.col("c_name").alias("nome")), "supplier": table(spark, d, "supplier").select(F.col("s_name").alias("nome"))}).select("grupo", "nome")


@query("upsert_dedupe", f"WITH {U} SELECT l_orderkey, l_linenumber, price, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_DESC}) AS r FROM U) WHERE r = 1")
def upsert_dedupe(spark, d):
    return merge.latest(views.changes(spark, d), ["l_orderkey", "l_linenumber"], ORDER).select("l_orderkey", "l_linenumber", "price", "l_returnflag")


_NULLED = {"price": "price % 3 = 0", "l_quantity": "l_linestatus = 'O'", "l_returnflag": "l_returnflag = 'N'"}


@query("upsert_field_merge", f"WITH {U} SELECT l_orderkey, l_linenumber, " + ", ".join(f"(list({c} ORDER BY {_DESC}) FILTER (NOT ({w})))[1] AS {c}" for c, w in _NULLED.items()) + " FROM U GROUP BY l_orderkey, l_linenumber")
def upsert_field_merge(spark, d):
    log = views.changes(spark, d)
    holes = log.withColumns({f"f_{c}": F.when(~F.expr(w), F.col(c)) for c, w in _NULLED.items()})
    out = merge.field_merge(holes, ["l_orderkey", "l_linenumber"], ORDER, [f"f_{c}" for c in _NULLED])
    return out.withColumnsRenamed({f"f_{c}": c for c in _NULLED})


@query("upsert_count", f"""WITH {U}, o AS (SELECT l_orderkey, l_linenumber, max(price) AS price FROM U WHERE l_orderkey % 2 = 0 GROUP BY ALL), n AS (SELECT l_orderkey, l_linenumber, max(price) + l_orderkey % 3 AS price FROM U GROUP BY l_orderkey, l_linenumber)
  SELECT count(*) FILTER (o.price IS NULL) AS n_inserted, count(*) FILTER (o.price <> n.price) AS n_modified, count(*) FILTER (o.price = n.price) AS n_same FROM n LEFT JOIN o ON n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber""")
def upsert_count(spark, d):
    keys = ["l_orderkey", "l_linenumber"]
    now = views.changes(spark, d).groupBy(*keys).agg(F.max("price").alias("price"))
    new = now.withColumn("price", F.col("price") + F.col("l_orderkey") % 3)
    return merge.affected(now.where("l_orderkey % 2 = 0"), new, keys, ["price"])


@query("route_events", f"WITH {V} SELECT event_id, CASE tipo WHEN 'epoca' THEN 'metricas' ELSE 'avaliacoes' END AS destino FROM V WHERE tipo IN ('epoca', 'estado_gerador')")
def route_events(spark, d):
    epochs, states = merge.route(views.run_events(spark, d), F.col("tipo"))
    return epochs.select("event_id", F.lit("metricas").alias("destino")).unionAll(states.select("event_id", F.lit("avaliacoes")))


_FOLD = f"""WITH {V}, u AS (SELECT *, sum(CASE WHEN tipo = 'inicio' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts, event_id) AS nth FROM V WHERE tipo IN ('inicio', 'epoca')),
  s AS (SELECT run, max(nth) AS starts FROM u GROUP BY run)
  SELECT s.run, CAST(s.starts AS BIGINT) AS starts, count(*) FILTER (u.tipo = 'epoca' AND u.nth = s.starts) AS n_epochs,
    coalesce(string_agg(CAST(u.epoca AS VARCHAR), ',' ORDER BY u.ts, u.event_id) FILTER (u.tipo = 'epoca' AND u.nth = s.starts), '') AS epochs FROM s JOIN u ON s.run = u.run GROUP BY s.run, s.starts"""


@query("run_state", _FOLD)
def run_state(spark, d):
    out = grouping.run_state(views.run_events(spark, d), "run", "tipo", ["ts", "event_id"], "epoca")
    return out.withColumn("epochs", F.array_join(F.col("epochs").cast("array<string>"), ","))


@query("last_n", f"WITH {V} SELECT event_id, tipo FROM V ORDER BY ts DESC, event_id DESC LIMIT 2000")
def last_n(spark, d):
    return grouping.last_n(views.run_events(spark, d), ["ts", "event_id"], 2000).select("event_id", "tipo")


def _stream(spark, d):
    path = f"{d}/events.parquet"
    like = table(spark, d, "events")
    kinds = views.run_events(spark, d)
    stream = runs.read(spark, path, like)
    kind = F.col("event_type")
    tipo = F.when(kind == "signup", "inicio").when(kind.isin("view", "click"), "epoca").when(kind == "purchase", "estado_gerador").otherwise("desconhecido")
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run"), tipo.alias("tipo"), F.get_json_object("props", "$.k").cast("int").alias("epoca"), "value", "event_type").select(*kinds.columns)


@query("stream_ingest", f"WITH {V} SELECT event_id, run, tipo, epoca FROM V")
def stream_ingest(spark, d):
    folder = runs.work_folder(spark)
    return storage.kept(runs.ingest(_stream(spark, d), folder).select("event_id", "run", "tipo", "epoca"), folder)


def _folded(spark, d):
    folder = runs.work_folder(spark)
    out = runs.fold_runs(_stream(spark, d), folder)
    return storage.kept(out.withColumn("epochs", F.array_join(F.col("epochs").cast("array<string>"), ",")), folder)


@query("stream_fold", _FOLD)
def stream_fold(spark, d):
    return _folded(spark, d).select("run", "starts", "n_epochs", "epochs")


@query("run_overview", f"""WITH {V}, used AS (SELECT * FROM V WHERE tipo IN ('inicio', 'epoca')),
  st AS (SELECT run, event_id, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) AS k FROM V WHERE tipo = 'estado_gerador'),
  cur AS (SELECT run FROM used ORDER BY ts DESC, event_id DESC LIMIT 1)
  SELECT r.run, st.event_id AS state_event, r.run = cur.run AS is_current FROM (SELECT DISTINCT run FROM used) r CROSS JOIN cur LEFT JOIN st ON st.run = r.run AND st.k = 1""")
def run_overview(spark, d):
    """The last generator state of each run, and which run is the current one, from the stream of events."""
    return _folded(spark, d).select("run", "state_event", "is_current")


@query("tumbling_counts", f"WITH {V} SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM V GROUP BY ALL")
def tumbling_counts(spark, d):
    folder = runs.work_folder(spark)
    counts, _ = runs.tumbling(_stream(spark, d), folder)
    return storage.kept(counts.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), folder)


@query("late_events", f"""WITH {V}, p AS (SELECT *, event_id % 3 AS f FROM V), m AS (SELECT k AS f, (SELECT max(ts) FROM p WHERE f < k) - INTERVAL 1 DAY AS mark FROM range(3) t(k))
  SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) FILTER (mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark) AS n,
    count(*) FILTER (date_trunc('day', ts) + INTERVAL 1 DAY <= mark) AS n_late, count(*) AS n_all FROM p JOIN m ON p.f = m.f GROUP BY ALL""")
def late_events(spark, d):
    """The events in three files, each over the whole time, so that most of the second and third come late: what was counted
    in time and what went to the table of late events."""
    folder = runs.work_folder(spark)
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):  # a file after another, in the order of their names
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    counts = None
    for k in range(3):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/part=[0-{k}]")
        counts, behind = runs.tumbling(stream, f"{folder}/out")
    late = behind.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n_late"))
    both = counts.join(late, ["start", "event_type"], "full").fillna(0, ["n", "n_late"])
    out = both.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "n_late", (F.col("n") + F.col("n_late")).alias("n_all"))
    return storage.kept(out, folder)


@query("session_counts", f"WITH {V}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY run ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM V), s AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, run, count(*) AS n FROM s GROUP BY run, k")
def session_counts(spark, d):
    return runs.sessions(views.run_events(spark, d), "run").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("curve_pivot", f"WITH {V} SELECT epoca, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS \"{t}\"" for t in ("click", "view")) + " FROM V WHERE tipo = 'epoca' GROUP BY epoca")
def curve_pivot(spark, d):
    return views.run_events(spark, d).where("tipo = 'epoca'").groupBy("epoca").pivot("event_type", ["click", "view"]).agg(r6(F.avg("value")))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("project_sample", f"WITH {L} SELECT key AS id, CASE WHEN y = 1 THEN 'fraude' ELSE 'legitimo' END AS rotulo, tecnica, gerador, CASE WHEN fonte IN ('ASIA', 'EUROPE') THEN 'reais' ELSE 'bid' END AS fonte_dados, substr(sha256('doc/' || documento_id), 1, 16) AS documento_id, CASE WHEN fonte IN ('ASIA', 'EUROPE') THEN substr(sha256('doc/' || documento_id), 1, 16) || '__' || 'edicao.png' ELSE key || '__edicao.png' END AS arquivo FROM L")
def project_sample(spark, d):
    rows = views.samples(spark, d)
    source = F.when(F.col("fonte").isin("ASIA", "EUROPE"), "reais").otherwise("bid")
    doc = privacy.document_id(F.concat(F.lit("doc/"), F.col("documento_id").cast("string")))
    name = F.concat("key", F.lit("__edicao.png"))
    label = F.coalesce(F.when(F.col("y") == 0, "legitimo"), F.lit("fraude"))
    return rows.select(F.col("key").alias("id"), label.alias("rotulo"), "tecnica", "gerador", source.alias("fonte_dados"), doc.alias("documento_id"), F.when(source == "reais", privacy.sanitize_file_name(name, doc)).otherwise(name).alias("arquivo"))


def _manifests(rows, version: int):
    """The samples of the view L as manifests, of which a later version has another difficulty."""
    k = F.col("key")
    params = F.concat(F.lit('{"modo": "alinhado", "texto_original": "nome", "fonte_rosto": "img/'), k, F.lit('.jpg", "lista": [1, {"p": "a/b"}]}'))
    values = {
        "id": k, "rotulo": F.when(F.col("y") == 0, "legitimo"), "tecnica": F.col("tecnica"), "gerador": F.col("gerador"), "dificuldade": F.lit(str(version)),
        "documento_origem": F.concat(F.lit("docs/"), F.col("documento_id").cast("string"), F.lit(".jpg")), "arquivo_gerado": F.concat(k, F.lit("__edicao.png")),
        "parametros": F.when(F.col("documento_id") % 3 != 0, F.parse_json(params)), "timestamp": F.lit(f"2024-01-0{version}"), "fonte_dados": F.when(F.col("fonte").isin("ASIA", "EUROPE"), "reais").otherwise("bid"),
    }
    kinds = dict(c.split(" ", 1) for c in schemas.MANIFEST.split(", ")) | {"fonte_dados": "string"}
    return rows.select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


_REAL = "fonte IN ('ASIA', 'EUROPE')"
_DOC = "substr(sha256('docs/' || documento_id || '.jpg'), 1, 16)"


@query("ingest_samples", f"""WITH {L} SELECT key AS id, CASE WHEN y = 1 THEN 'fraude' ELSE 'legitimo' END AS rotulo, tecnica, gerador, CASE WHEN documento_id % 2 = 0 THEN '2' ELSE '1' END AS dificuldade, CASE WHEN {_REAL} THEN 'reais' ELSE 'bid' END AS fonte_dados,
  {_DOC} AS documento_id, CASE WHEN {_REAL} THEN {_DOC} || '__edicao.png' ELSE key || '__edicao.png' END AS arquivo, CASE WHEN documento_id % 3 <> 0 THEN 'alinhado' END AS modo,
  CASE WHEN documento_id % 3 <> 0 AND NOT ({_REAL}) THEN 'nome' END AS texto_original, CASE WHEN documento_id % 3 <> 0 THEN CASE WHEN {_REAL} THEN substr(sha256('img/' || key || '.jpg'), 1, 16) ELSE 'img/' || key || '.jpg' END END AS fonte_rosto,
  CASE WHEN documento_id % 3 <> 0 THEN CASE WHEN {_REAL} THEN substr(sha256('a/b'), 1, 16) ELSE 'a/b' END END AS fundo FROM L""")
def ingest_samples(spark, d):
    """A table is filled with the first version of all samples; a later version of every other document follows."""
    folder = storage.new_folder(spark, "amostras")
    # a part of 250,000 samples is sorted in some 400 MB
    parts = max(spark.sparkContext.defaultParallelism, 1 + table(spark, d, "lineitem").count() // 250_000)
    # the samples are joined and dealt by their ids once, while they are narrow; neither merge moves them again
    rows, to, name = views.samples(spark, d).drop("score").repartition(parts, "key"), f"{folder}/tabela", f"amostras_{uuid4().hex}"
    rows = sinks.write_bucketed(rows, name, ["key"], parts, f"{folder}/vista").sortWithinPartitions("key")
    ingest.ingest_manifests(_manifests(rows, 1), to, parts, keep=0)
    ingest.ingest_manifests(_manifests(rows.where("documento_id % 2 = 0"), 2), to, parts, keep=0)
    spark.sql(f"DROP TABLE {name}")
    storage.delete(spark, f"{folder}/vista")
    of = lambda path: F.variant_get("parametros", path, "string")
    out = sinks.read_table(spark, to)
    return out.select("id", "rotulo", "tecnica", "gerador", "dificuldade", "fonte_dados", "documento_id", "arquivo", of("$.modo").alias("modo"), of("$.texto_original").alias("texto_original"), of("$.fonte_rosto").alias("fonte_rosto"), of("$.lista[1].p").alias("fundo"))


@query("ingest_events", f"WITH {V} SELECT 'metricas' AS destino, count(DISTINCT (run, epoca)) AS n_inserted FROM V WHERE tipo = 'epoca' UNION ALL SELECT 'avaliacoes', count(DISTINCT (run, ts)) FROM V WHERE tipo = 'estado_gerador'")
def ingest_events(spark, d):
    rows = views.run_events(spark, d).select(F.col("run").cast("string").alias("run_id"), F.unix_micros("ts").alias("ts"), "tipo", "epoca", F.col("value").alias("loss_treino"))
    folder = storage.new_folder(spark, "eventos")
    epochs, states = ingest.ingest_events(rows, f"{folder}/metricas", f"{folder}/avaliacoes")
    out = epochs.select(F.lit("metricas").alias("destino"), "n_inserted").unionAll(states.select(F.lit("avaliacoes"), "n_inserted"))
    return storage.kept(out, folder)


def _norm(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


@query("l2_normalize", f"WITH {E}, n AS (SELECT vec_id, {_norm('v')} AS u FROM E) SELECT vec_id, round(list_inner_product(u, u), 6) AS length, round(u[1], 6) AS first, round(u[64], 6) AS last FROM n")
def l2_normalize(spark, d):
    u = views.vectors(spark, d).select("vec_id", anomaly.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", r6(anomaly.dot(F.col("u"), F.col("u"))).alias("length"), r6(F.col("u")[0]).alias("first"), r6(F.element_at("u", -1)).alias("last"))


_LOCAL = f"""WITH {G}, o AS (SELECT a, b FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) WHERE a <> 0 OR b <> 0),
  nb AS (SELECT g.img, g.i, g.j, unnest(q.v) AS x, unnest(range(1, len(q.v) + 1)) AS k FROM G g CROSS JOIN o JOIN G q ON q.img = g.img AND q.i = greatest(0, least(4, g.i + o.a)) AND q.j = greatest(0, least(4, g.j + o.b))),
  s AS (SELECT img, i, j, k, sum(x) / 8 AS x FROM nb GROUP BY ALL), m AS (SELECT img, i, j, list(x ORDER BY k) AS m FROM s GROUP BY ALL),
  local AS (SELECT G.img, G.i, G.j, 1 - list_inner_product(G.v, {_norm('m.m')}) AS dev FROM G JOIN m ON G.img = m.img AND G.i = m.i AND G.j = m.j),
  gs AS (SELECT img, k, avg(x) AS x FROM (SELECT img, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS k FROM G) GROUP BY ALL), gm AS (SELECT img, list(x ORDER BY k) AS m FROM gs GROUP BY img),
  global_dev AS (SELECT G.img, G.i, G.j, 1 - list_inner_product(G.v, {_norm('gm.m')}) AS dev FROM G JOIN gm ON G.img = gm.img)"""


@query("patch_local_dev", f"{_LOCAL} SELECT img, i, j, round(dev, 6) AS dev FROM local")
def patch_local_dev(spark, d):
    return anomaly.local_deviation(views.grids(spark, d), 5).withColumn("dev", r6("dev"))


@query("vector_global_dev", f"{_LOCAL} SELECT img, i, j, round(dev, 6) AS dev FROM global_dev")
def vector_global_dev(spark, d):
    return anomaly.global_deviation(views.grids(spark, d)).withColumn("dev", r6("dev"))


def _stats_sql(prefix: str) -> str:
    parts = {"max": "max(dev)", "p99": "quantile_cont(dev, 0.99)", "p95": "quantile_cont(dev, 0.95)", "media": "avg(dev)", "desvio": "stddev_samp(dev)", "pico_media": "max(dev) / (avg(dev) + 1e-6)"}
    return ", ".join(f"round({v}, 5) AS {prefix}{k}" for k, v in parts.items())


@query("anomaly_summary", f"{_LOCAL} SELECT * FROM (SELECT img, {_stats_sql('local_')} FROM local GROUP BY img) JOIN (SELECT img, {_stats_sql('global_')} FROM global_dev GROUP BY img) USING (img)")
def anomaly_summary(spark, d):
    out = anomaly.anomaly_vector(views.grids(spark, d), 5)
    return out.select("img", *[r6(c, 5).alias(c) for c in out.columns if c != "img"])


@query("concat_vectors", f"WITH {E} SELECT vec_id, CAST(len(v) + 2 AS INT) AS n, round(list_sum(v) + 2 * y + fonte, 6) AS total FROM E")
def concat_vectors(spark, d):
    both = anomaly.concat_vectors(F.col("embedding"), F.array((2 * F.col("y")).cast("double"), F.col("fonte").cast("double")))
    return views.vectors(spark, d).select("vec_id", both.alias("c")).select("vec_id", F.size("c").alias("n"), r6(F.aggregate("c", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("standardize", f"WITH {E}, c AS (SELECT vec_id, fonte, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS k FROM E), s AS (SELECT k, avg(x) AS m, stddev_pop(x) AS d FROM c WHERE fonte = 0 GROUP BY k) SELECT vec_id, round(min((x - m) / d), 5) AS low, round(max((x - m) / d), 5) AS high FROM c JOIN s ON c.k = s.k GROUP BY vec_id")
def standardize(spark, d):
    out = anomaly.standardize(views.vectors(spark, d), "vec_id", "embedding", F.col("fonte") == 0)
    return out.select("vec_id", r6(F.array_min("z"), 5).alias("low"), r6(F.array_max("z"), 5).alias("high"))


@query("periodic_diff_ratio", f"WITH {E}, c AS (SELECT vec_id, unnest(range(1, len(v))) AS k, v FROM E), s AS (SELECT vec_id, k, abs(v[k + 1] - v[k]) AS d FROM c) SELECT vec_id, round(avg(d) FILTER (k % 8 = 0) / (avg(d) + 1e-6), 5) AS ratio FROM s GROUP BY vec_id")
def periodic_diff_ratio(spark, d):
    return views.vectors(spark, d).select("vec_id", r6(anomaly.boundary_ratio(F.col("embedding")), 5).alias("ratio"))


@query("raster_stats")
def raster_stats(spark, d):
    """The vectors as rasters of eight by eight cells."""
    out = anomaly.raster_statistics(views.vectors(spark, d), "vec_id", "embedding", 8, period=4)
    return out.select("vec_id", *[r6(c).alias(c) for c in anomaly.RASTER])

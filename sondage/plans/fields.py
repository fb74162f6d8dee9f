"""Queries of privacy, validation, display and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import display, fields, privacy
from ..operators import auc as A
from ..operators import grouping, pairing, regions
from ..sources.files import table
from ..storage import checkpoint
from . import views
from .registry import B as BOXES
from .registry import D, auc, hist, query, r6

PATH = privacy.PATH_LIKE


@query("pseudonymize", "SELECT page_id, substr(sha256(url), 1, 16) AS documento_id FROM pages")
def pseudonymize(spark, d):
    return table(spark, d, "pages").select("page_id", privacy.document_id(F.col("url")).alias("documento_id"))


@query("path_like", f"SELECT 'page' AS kind, page_id AS id, regexp_matches(url, '{PATH}') AS is_path FROM pages UNION ALL SELECT 'part', p_partkey, regexp_matches(p_name, '{PATH}') FROM part")
def path_like(spark, d):
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), privacy.path_like(F.col("url")).alias("is_path"))
    return pages.unionAll(table(spark, d, "part").select(F.lit("part"), "p_partkey", privacy.path_like(F.col("p_name"))))


@query("sanitize_map", "SELECT event_id, json_extract_string(props, '$.k') AS k, substr(sha256('img/' || event_id || '.png'), 1, 16) AS fonte_rosto, event_type AS modo FROM events")
def sanitize_map(spark, d):
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("fonte_rosto"), F.concat(F.lit("img/"), "event_id", F.lit(".png")), F.lit("modo"), F.col("event_type"))
    clean = privacy.sanitize_map(m)
    return table(spark, d, "events").select("event_id", clean.alias("m")).select("event_id", *[F.col("m")[k].alias(k) for k in ("k", "fonte_rosto", "modo")])


@query("sanitize_json", """SELECT page_id, '{"a": ["' || substr(sha256(url), 1, 16) || '", 1], "b": {"c": "x"}}' AS clean FROM pages""")
def sanitize_json(spark, d):
    text = F.concat(F.lit('{"a": ["'), "url", F.lit('", 1], "b": {"c": "x"}}'))
    return table(spark, d, "pages").select("page_id", privacy.sanitize_json(text).alias("clean"))


@query("sanitize_filename", "SELECT c_custkey, substr(sha256(c_name), 1, 16) || '__' || CASE WHEN c_custkey % 3 = 0 THEN 'nome.png' WHEN c_custkey % 3 = 1 THEN 'foto__2.png' ELSE c_name || '.png' END AS arquivo FROM customer")
def sanitize_filename(spark, d):
    n = F.col("c_custkey") % 3
    name = F.when(n == 0, F.concat("c_name", F.lit("__nome.png"))).when(n == 1, F.concat("c_name", F.lit("__foto__2.png"))).otherwise(F.concat(F.lit("pasta/"), "c_name", F.lit(".png")))
    return table(spark, d, "customer").select("c_custkey", privacy.sanitize_file_name(name, privacy.document_id(F.col("c_name"))).alias("arquivo"))


@query("drop_sensitive", "SELECT event_id, CAST(1 AS INT) AS n_keys, json_extract_string(props, '$.k') AS k FROM events")
def drop_sensitive(spark, d):
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("texto_original"), F.col("event_type"))
    out = table(spark, d, "events").select("event_id", privacy.drop_sensitive(m).alias("m"))
    return out.select("event_id", F.size("m").alias("n_keys"), F.col("m")["k"].alias("k"))


@query("sanitize_by_source", "SELECT doc_id, CASE WHEN lang = 'en' THEN source || '/' || doc_id ELSE substr(sha256(source || '/' || doc_id), 1, 16) END AS valor FROM documents")
def sanitize_by_source(spark, d):
    path = F.concat_ws("/", "source", "doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", path).otherwise(privacy.sanitize_value(path)).alias("valor"))


@query("digits_only", "SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n, md5(regexp_replace(text, '[^0-9]', '', 'g')) AS digest FROM documents")
def digits_only(spark, d):
    digits = fields.digits_only(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(digits).cast("long").alias("n"), F.md5(digits).alias("digest"))


_NINE = "lpad(CAST(c_custkey AS VARCHAR), 9, '0')"


def _check_sql(text: str, n: int) -> str:
    return f"CAST(list_sum(list_transform(range(1, {n + 1}), lambda i: CAST(substr({text}, CAST(i AS INT), 1) AS INT) * ({n + 2} - i))) * 10 % 11 % 10 AS INT)"


IDS = f"""n AS (SELECT c_custkey, c_name, {_NINE} AS nine FROM customer), t AS (SELECT *, nine || {_check_sql('nine', 9)} AS ten FROM n), g AS (SELECT *, {_check_sql('ten', 10)} AS last FROM t),
  I AS (SELECT c_custkey, c_name, nine, ten || CAST((last + CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS cpf, ten || last AS good FROM g)"""
_FORMAT = r"regexp_replace(cpf, '^([0-9]{3})([0-9]{3})([0-9]{3})([0-9]{2})$', '\1.\2.\3-\4')"


@query("cpf_valid", f"WITH {IDS} SELECT c_custkey, cpf, cpf = good AND NOT regexp_matches(cpf, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS valid FROM I")
def cpf_valid(spark, d):
    return views.ids(spark, d).select("c_custkey", "cpf", fields.valid_cpf(fields.format_id(F.col("cpf"))).alias("valid"))


@query("format_id", f"WITH {IDS} SELECT c_custkey, {_FORMAT} AS formatted FROM I")
def format_id(spark, d):
    return views.ids(spark, d).select("c_custkey", fields.format_id(F.col("cpf")).alias("formatted"))


@query("strip_accents", "SELECT doc_id, md5(upper(replace(strip_accents(text), 'ß', 'SS'))) AS digest FROM documents")
def strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fields.strip_accents(F.col("text"))).alias("digest"))


_STOP = ["ALMOND", "PART", "AZURE", "RED", "1", "NOME"]


@query("is_label", f"SELECT p_partkey, len(list_intersect(regexp_split_to_array(regexp_replace(upper(strip_accents(p_name)), '[./#]', ' ', 'g'), '\\s+'), {_STOP})) > 0 AS is_label, len(list_intersect(regexp_split_to_array(regexp_replace(upper(strip_accents(p_type)), '[./]', ' ', 'g'), '\\s+'), ['NOME', 'SMALL', 'PROMO'])) > 0 AS type_label FROM part")
def is_label(spark, d):
    name = F.replace(F.col("p_name"), F.lit("#"), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", fields.is_label(name, _STOP).alias("is_label"), fields.is_label(F.col("p_type"), ["NOME", "SMALL", "PROMO"]).alias("type_label"))


def _name_like_sql(c: str) -> str:
    words = rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: regexp_matches(w, '\p{{L}}'))"
    return rf"(len({words}) >= 2 AND len(list_filter({words}, lambda w: length(w) < 2)) = 0 AND NOT regexp_matches({c}, '\p{{Nd}}'))"


@query("name_like", f"SELECT 'c' AS kind, c_custkey AS id, {_name_like_sql('c_name')} AS v FROM customer UNION ALL SELECT 'p', p_partkey, {_name_like_sql('p_name')} FROM part UNION ALL SELECT 's', doc_id, {_name_like_sql('text')} FROM documents")
def name_like(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), fields.name_like(F.col("c_name")).alias("v"))
    p = table(spark, d, "part").select(F.lit("p"), "p_partkey", fields.name_like(F.col("p_name")))
    s = table(spark, d, "documents").select(F.lit("s"), "doc_id", fields.name_like(F.col("text")))
    return c.unionAll(p).unionAll(s)


_SHAPED = "CASE c_custkey % 5 WHEN 0 THEN '01/02/2024' WHEN 1 THEN " + _FORMAT + " WHEN 2 THEN cpf WHEN 3 THEN 'Maria Souza' ELSE c_name END"


@query("classify_shape", rf"WITH {IDS}, s AS (SELECT c_custkey, {_SHAPED} AS t FROM I) SELECT c_custkey, CASE WHEN regexp_matches(t, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN 'data' WHEN regexp_matches(t, '^[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{3}}-[0-9]{{2}}$') THEN 'cpf' WHEN regexp_matches(t, '^[0-9]{{7,}}$') THEN 'registro' WHEN {_name_like_sql('t')} THEN 'nome' END AS tipo FROM s")
def classify_shape(spark, d):
    n = F.col("c_custkey") % 5
    text = F.when(n == 0, "01/02/2024").when(n == 1, fields.format_id(F.col("cpf"))).when(n == 2, F.col("cpf")).when(n == 3, "Maria Souza").otherwise(F.col("c_name"))
    return views.ids(spark, d).select("c_custkey", fields.shape(text).alias("tipo"))


@query("stem_prefix", "SELECT c_custkey, c_name AS documento FROM customer")
def stem_prefix(spark, d):
    path = F.concat(F.lit("pasta/x__y/"), "c_name", F.when(F.col("c_custkey") % 2 == 0, "__edicao__1.png").otherwise(".jpeg"))
    return table(spark, d, "customer").select("c_custkey", fields.stem_prefix(path).alias("documento"))


@query("char_coverage", "SELECT p_partkey, round(coalesce(len(list_filter(c, lambda x: list_contains(['a','B','r','t','1','2','3','#'], x) OR list_contains(['a','B','r','t','1','2','3','#'], upper(x)) OR list_contains(['a','B','r','t','1','2','3','#'], lower(x)))) / nullif(len(c), 0), 0), 6) AS coverage FROM (SELECT p_partkey, list_filter(string_split(p_name, ''), lambda x: x <> '' AND NOT regexp_matches(x, '\\s')) AS c FROM part)")
def char_coverage(spark, d):
    bank = F.array(*map(F.lit, "aBrt123#"))
    return table(spark, d, "part").select("p_partkey", r6(fields.char_coverage(F.col("p_name"), bank)).alias("coverage"))


#: AUC of each source and language of documents, null where it has one class only, and of the source as a whole.
_AREAS = f"""WITH {D}, h AS ({hist('D', 'fonte, tecnica')}), hs AS ({hist('D', 'fonte')}), per AS ({auc('h', 'fonte, tecnica', None)}), whole AS ({auc('hs', 'fonte', None)}),
  A AS (SELECT g.fonte, g.tecnica, round(per.auc, 6) AS v, round(whole.auc, 6) AS sep FROM (SELECT DISTINCT source AS fonte, lang AS tecnica FROM documents) g LEFT JOIN per ON per.fonte = g.fonte AND per.tecnica = g.tecnica LEFT JOIN whole ON whole.fonte = g.fonte)"""


def _areas(spark, d):
    rows = views.texts(spark, d)
    kinds = table(spark, d, "documents").select(F.col("source").alias("fonte"), F.col("lang").alias("tecnica")).distinct()
    per, whole = A.auc(rows, ("fonte", "tecnica")), A.auc(rows, ("fonte",))
    return kinds.join(per.select("fonte", "tecnica", r6("auc").alias("v")), ["fonte", "tecnica"], "left").join(whole.select("fonte", r6("auc").alias("sep")), "fonte", "left")


@query("format_auc", f"{_AREAS} SELECT fonte, tecnica, CASE WHEN v IS NULL THEN '—' ELSE replace(printf('%.3f', v), '.', ',') END AS shown FROM A")
def format_auc(spark, d):
    return _areas(spark, d).select("fonte", "tecnica", display.format_auc(F.col("v")).alias("shown"))


@query("auc_band", f"""{_AREAS} SELECT fonte, tecnica, CASE WHEN v IS NULL THEN 'info' WHEN v < 0.55 THEN 'ok' WHEN v < 0.7 THEN 'info' WHEN v < 0.9 THEN 'warn' ELSE 'bad' END AS variante,
  CASE WHEN v IS NULL THEN '—' WHEN v < 0.55 THEN 'não distingue' WHEN v < 0.7 THEN 'sinal fraco' WHEN v < 0.9 THEN 'sinal forte' ELSE 'suspeito' END AS rotulo FROM A""")
def auc_band(spark, d):
    return _areas(spark, d).select("fonte", "tecnica", display.band(F.col("v")).alias("b")).select("fonte", "tecnica", "b.*")


@query("verdict", f"""{_AREAS} SELECT fonte, tecnica, CASE WHEN v >= 0.7 AND (sep IS NULL OR sep < 0.9) THEN 'bom' WHEN v >= 0.6 THEN 'meio' ELSE 'ruim' END AS verdict,
  CASE WHEN v < 0.55 THEN CASE WHEN tecnica = 'en' THEN 'esperado' ELSE 'sem sinal' END WHEN v < 0.7 THEN 'sinal fraco' WHEN v < 0.9 THEN 'consistente' ELSE 'atalho' END AS technique FROM A WHERE v IS NOT NULL""")
def verdict(spark, d):
    key = F.when(F.col("tecnica") == "en", "edicao_campos").otherwise("troca_foto")
    return _areas(spark, d).where("v is not null").select("fonte", "tecnica", display.verdict(F.col("v"), F.col("sep")).alias("verdict"), display.technique_text(key, F.col("v")).alias("technique"))


@query("gauge_position", f"{_AREAS} SELECT fonte, tecnica, round(greatest(0, least(1, (coalesce(v, 0.5) - 0.5) / 0.5)) * 100, 4) AS position FROM A")
def gauge_position(spark, d):
    return _areas(spark, d).select("fonte", "tecnica", r6(display.gauge_position(F.col("v")), 4).alias("position"))


@query("lookup_default", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Clique' WHEN 'view' THEN 'Visita' ELSE event_type END AS nome, ['#4c8dff','#2ea56b','#a78bfa','#c8922a','#d9544d','#22b8cf'][CAST(event_id % 6 AS INT) + 1] AS cor FROM events")
def lookup_default(spark, d):
    return table(spark, d, "events").select("event_id", display.shown_name(F.col("event_type"), {"click": "Clique", "view": "Visita"}).alias("nome"), display.series_colour(F.col("event_id")).alias("cor"))


@query("box_parse", f"WITH {BOXES} SELECT key, x, y, w, h, texto || ', x' AS texto FROM B WHERE line % 3 <> 0")
def box_parse(spark, d):
    rows = views.boxes(spark, d)
    good = F.concat_ws(",", "x", F.concat(F.lit(" "), "y"), "w", "h", F.concat("texto", F.lit(", x ")))
    line = F.when(F.col("line") % 3 != 0, good).when(F.col("line") % 2 == 0, "X,y,w,h,texto").otherwise(F.concat(F.lit("1.5,2,3,4,"), "texto"))
    return rows.select("key", B.parse(line).alias("b")).where("b is not null").select("key", "b.*")


@query("box_geometry", f"WITH {BOXES} SELECT key, x + w AS x2, y + h AS y2, CAST(w * h AS BIGINT) AS area, x + w / 2 AS cx, y + h / 2 AS cy, x + w // 2 AS icx, y + h // 2 AS icy FROM B")
def box_geometry(spark, d):
    return views.boxes(spark, d).select("key", F.struct(*B.SIDES).alias("b")).select("key", *[c.alias(k) for k, c in B.geometry(F.col("b")).items()])


@query("rotate_box", f"""WITH {BOXES}, a AS (SELECT *, CAST((line % 5) * 90 AS INT) AS angle FROM B)
  SELECT key, angle, CASE angle WHEN 90 THEN 599 - y - h WHEN 180 THEN 1599 - x - w WHEN 270 THEN y ELSE x END AS x, CASE angle WHEN 90 THEN x WHEN 180 THEN 599 - y - h WHEN 270 THEN 1599 - x - w ELSE y END AS y,
    CASE WHEN angle IN (90, 270) THEN h ELSE w END AS w, CASE WHEN angle IN (90, 270) THEN w ELSE h END AS h FROM a""")
def rotate_box(spark, d):
    rows = views.boxes(spark, d).withColumn("angle", (F.col("line") % 5 * 90).cast("int"))
    turned = B.rotate_all(F.array(F.struct(*B.SIDES)), F.lit(1600), F.lit(600), F.col("angle"))[0]
    return rows.select("key", "angle", turned.alias("b")).select("key", "angle", "b.*")


@query("clamp_box", f"WITH {BOXES} SELECT key, greatest(0, x - 200) AS x, greatest(0, y - 100) AS y, greatest(0, least(500, x - 200 + w) - greatest(0, x - 200)) AS w, greatest(0, least(250, y - 100 + h) - greatest(0, y - 100)) AS h FROM B")
def clamp_box(spark, d):
    b = F.struct((F.col("x") - 200).alias("x"), (F.col("y") - 100).alias("y"), "w", "h")
    return views.boxes(spark, d).select("key", B.clamp(b, F.lit(500), F.lit(250)).alias("b")).select("key", "b.*")


@query("argmax_area", f"WITH {BOXES} SELECT doc, key, area FROM (SELECT doc, key, CAST(w * h AS BIGINT) AS area, row_number() OVER (PARTITION BY doc ORDER BY w * h DESC, line, key) AS r FROM B) WHERE r = 1")
def argmax_area(spark, d):
    rows = views.boxes(spark, d).withColumn("area", F.col("w").cast("long") * F.col("h"))
    return grouping.argmax(rows, "doc", F.col("area"), ["line", "key"], ["key", "area"])


@query("bbox_union", f"WITH {BOXES} SELECT doc, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM B GROUP BY doc")
def bbox_union(spark, d):
    return pairing.bounding(views.boxes(spark, d), ["doc"])


@query("nearest_neighbor", f"""WITH {BOXES} SELECT doc, key, label, distance FROM (
  SELECT v.doc, v.key, l.texto AS label, round((v.x + v.w / 2 - l.x - l.w / 2) * (v.x + v.w / 2 - l.x - l.w / 2) + (v.y + v.h / 2 - l.y - l.h / 2) * (v.y + v.h / 2 - l.y - l.h / 2), 4) AS distance,
    row_number() OVER (PARTITION BY v.key ORDER BY (v.x + v.w / 2 - l.x - l.w / 2) * (v.x + v.w / 2 - l.x - l.w / 2) + (v.y + v.h / 2 - l.y - l.h / 2) * (v.y + v.h / 2 - l.y - l.h / 2), l.key) AS r
  FROM B v JOIN B l ON v.doc = l.doc AND v.line % 2 = 0 AND l.line % 2 = 1) WHERE r = 1""")
def nearest_neighbor(spark, d):
    rows = views.boxes(spark, d)
    labels = rows.where("line % 2 = 1").select("doc", *B.SIDES, F.col("texto").alias("name"), F.col("key").alias("at"))
    out = pairing.nearest_label(rows.where("line % 2 = 0"), labels, "doc", ["key"], "name", ["at"])
    return out.withColumn("distance", F.round("distance", 4))


@query("mode_label", f"WITH {BOXES}, c AS (SELECT doc, texto, count(*) AS n FROM B GROUP BY ALL) SELECT doc, texto, n FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, texto) AS r FROM c) WHERE r = 1")
def mode_label(spark, d):
    return grouping.most_frequent(views.boxes(spark, d), "doc", "texto")


@query("axis_vote", f"WITH {BOXES} SELECT doc, count(*) FILTER (w >= h) AS horizontal, count(*) FILTER (w < h) AS vertical, CASE WHEN count(*) FILTER (w >= h) >= count(*) FILTER (w < h) THEN 0 ELSE 90 END AS axis FROM B GROUP BY doc")
def axis_vote(spark, d):
    return pairing.axis_vote(views.boxes(spark, d), "doc")


@query("word_score", f"WITH {BOXES} SELECT doc, round(sum(CASE WHEN conf > 0 AND length(regexp_replace(texto, '[^\\p{{L}}]', '', 'g')) >= 3 THEN conf ELSE 0 END), 3) AS score, round(sum(CASE WHEN conf > 0 AND length(regexp_replace(texto, '[^\\p{{L}}]', '', 'g')) >= 3 THEN conf ELSE 0 END), 3) >= 60 AS readable FROM B GROUP BY doc")
def word_score(spark, d):
    out = pairing.word_score(views.boxes(spark, d), ["doc"])
    return out.withColumn("score", F.round("score", 3))


@query("range_join_lines", f"""WITH {BOXES}, m AS (SELECT *, regexp_matches(texto, '(ring|gear)$') AS lab FROM B),
  labs AS (SELECT doc, key AS label, block, line, x AS lx, y AS ly, w AS lw, h AS lh FROM m WHERE lab),
  same AS (SELECT l.doc, l.label, 0 AS kind, min(m.x) AS x, least(min(m.y), min(ly)) AS y, max(m.x + m.w) AS x2, greatest(max(m.y + m.h), max(ly + lh)) AS y2, count(*) AS n FROM labs l JOIN m ON l.doc = m.doc AND l.block = m.block AND l.line = m.line AND m.x > lx + lw GROUP BY l.doc, l.label),
  lines AS (SELECT doc, block, line, min(x) AS x, min(y) AS y, max(x + w) AS x2, max(y + h) AS y2, count(*) AS n, bool_or(lab) AS stop, row_number() OVER (PARTITION BY doc, block ORDER BY line) AS at FROM m GROUP BY doc, block, line),
  below AS (SELECT l.doc, l.label, CAST(b.at - a.at AS INT) AS kind, b.x, b.y, b.x2, b.y2, b.n, b.stop FROM labs l JOIN lines a ON l.doc = a.doc AND l.block = a.block AND l.line = a.line JOIN lines b ON b.doc = a.doc AND b.block = a.block AND b.at BETWEEN a.at + 1 AND a.at + 2),
  kept AS (SELECT * FROM (SELECT *, min(kind) FILTER (stop) OVER (PARTITION BY doc, label) AS first FROM below) WHERE first IS NULL OR kind < first)
  SELECT doc, label, kind, x, y, x2 - x AS w, y2 - y AS h, n FROM (SELECT doc, label, kind, x, y, x2, y2, n FROM same UNION ALL SELECT doc, label, kind, x, y, x2, y2, n FROM kept)""")
def range_join_lines(spark, d):
    return pairing.values_of_labels(views.boxes(spark, d), F.col("texto").rlike("(ring|gear)$"), "doc", "key")




@query("detect_rotation", f"""WITH {BOXES}, v AS (SELECT doc, CASE WHEN count(*) FILTER (w >= h) >= count(*) FILTER (w < h) THEN 0 ELSE 90 END AS axis, round(sum(conf)) AS conf FROM B GROUP BY doc),
  s AS (SELECT doc, r.rot, axis, conf * ((doc + r.rot // 90) % 4) AS score FROM v, (VALUES (0), (90), (180), (270)) r(rot))
  SELECT doc, rotation FROM (SELECT doc, rot AS rotation, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, rot) AS k FROM s WHERE rot % 180 = axis % 180) WHERE k = 1 AND score >= 60""")
def detect_rotation(spark, d):
    rows = views.boxes(spark, d)
    per = rows.groupBy("doc").agg(F.round(F.sum("conf")).alias("conf")).withColumn("rot", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))))
    scores = per.select("doc", "rot", (F.col("conf") * ((F.col("doc") + F.floor(F.col("rot") / 90)) % 4)).alias("score"))
    return pairing.rotation(rows, scores, "doc")


_CASES = "CASE line % 5 WHEN 0 THEN '01/02/2024' WHEN 1 THEN texto || ' da Silva' WHEN 2 THEN '1234567890' WHEN 3 THEN 'NOME: ' || texto ELSE 'FILIACAO ' || texto END"
_D2 = "(a.x + a.w / 2 - l.x - l.w / 2) * (a.x + a.w / 2 - l.x - l.w / 2) + (a.y + a.h / 2 - l.y - l.h / 2) * (a.y + a.h / 2 - l.y - l.h / 2)"


@query("classify_fields", f"""WITH {BOXES}, t AS (SELECT key, doc, x, y, w, h, {_CASES} AS texto FROM B WHERE w > h),
  l AS (SELECT *, CASE WHEN contains(texto, 'NOME') THEN 0 ELSE 1 END AS kind FROM t WHERE contains(texto, 'NOME') OR contains(texto, 'FILIACAO')),
  c AS (SELECT *, CASE WHEN regexp_matches(texto, '^[0-9]{{2}}/') THEN 'data' WHEN regexp_matches(texto, '^[0-9]{{7,}}$') THEN 'registro' ELSE 'nome' END AS tipo FROM t WHERE NOT contains(texto, 'NOME') AND NOT contains(texto, 'FILIACAO')),
  n AS (SELECT key, kind FROM (SELECT a.key, l.kind, row_number() OVER (PARTITION BY a.key ORDER BY {_D2}, l.kind, l.key) AS r FROM c a JOIN l ON a.doc = l.doc AND a.tipo = 'nome') WHERE r = 1)
  SELECT c.doc, c.key, CASE WHEN c.tipo = 'nome' AND n.kind = 1 THEN 'filiacao' ELSE c.tipo END AS tipo, c.texto FROM c LEFT JOIN n ON c.key = n.key""")
def classify_fields(spark, d):
    rows = views.boxes(spark, d)
    n = F.col("line") % 5
    text = F.when(n == 0, "01/02/2024").when(n == 1, F.concat("texto", F.lit(" da Silva"))).when(n == 2, "1234567890").when(n == 3, F.concat(F.lit("NOME: "), "texto")).otherwise(F.concat(F.lit("FILIACAO "), "texto"))
    rows = rows.withColumn("texto", text)
    plain = fields.strip_accents(F.col("texto"))
    keywords = {k: F.contains(plain, F.lit(k)) for k in ("NOME", "FILIACAO")}
    return pairing.classify_fields(rows, "doc", ["key"], keywords, fields.is_label(F.regexp_replace("texto", ":", " ")))


_ROT = """V AS (SELECT doc, CASE WHEN count(*) FILTER (w >= h) >= count(*) FILTER (w < h) THEN 0 ELSE 90 END AS axis, round(sum(conf)) AS conf, count(*) AS n_boxes FROM B GROUP BY doc),
  S AS (SELECT doc, r.rot, axis, n_boxes, conf * ((doc + r.rot // 90) % 4) AS score FROM V, (VALUES (0), (90), (180), (270)) r(rot)),
  R AS (SELECT doc, rot AS rotation, n_boxes FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, rot) AS k FROM S WHERE rot % 180 = axis % 180) WHERE k = 1 AND score >= 60)"""


@query("load_documents", f"""WITH {BOXES}, {_ROT},
  U AS (SELECT key, B.doc, {_CASES} AS texto, R.rotation, R.n_boxes, CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS uw, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS uh FROM B JOIN R ON B.doc = R.doc)
  SELECT doc, rotation, n_boxes, count(*) AS n_fields, count(*) FILTER (regexp_matches(texto, '^[0-9]{{2}}/')) AS n_dates FROM U
  WHERE uw > uh AND NOT contains(texto, 'NOME') AND NOT contains(texto, 'FILIACAO') GROUP BY doc, rotation, n_boxes""")
def load_documents(spark, d):
    rows = views.boxes(spark, d)
    per = checkpoint(rows.groupBy("doc").agg(F.round(F.sum("conf")).alias("conf")))
    scores = per.withColumn("rot", F.explode(F.array(*map(F.lit, (0, 90, 180, 270))))).select("doc", "rot", (F.col("conf") * ((F.col("doc") + F.floor(F.col("rot") / 90)) % 4)).alias("score"))
    n = F.col("line") % 5
    text = F.when(n == 0, "01/02/2024").when(n == 1, F.concat("texto", F.lit(" da Silva"))).when(n == 2, "1234567890").when(n == 3, F.concat(F.lit("NOME: "), "texto")).otherwise(F.concat(F.lit("FILIACAO "), "texto"))
    documents = per.select("doc", F.lit(1600).alias("width"), F.lit(600).alias("height"))
    plain = fields.strip_accents(F.col("texto"))
    out = pairing.load_documents(documents, rows.withColumn("texto", text), scores, "doc", ["key"], lambda: {k: F.contains(plain, F.lit(k)) for k in ("NOME", "FILIACAO")}, lambda: fields.is_label(F.regexp_replace("texto", ":", " ")))
    return out.select("doc", "rotation", "n_boxes", F.size("fields").cast("long").alias("n_fields"), F.size(F.filter("fields", lambda f: f["tipo"] == "data")).cast("long").alias("n_dates"))


@query("region_union", f"""WITH RECURSIVE {BOXES}, q AS (SELECT doc, (line % 4) || ':' || key AS id, line % 4 AS r, texto, greatest(x - 3, 0) AS a, greatest(y - 3, 0) AS c,
    least(x + w + 3, CASE WHEN line % 2 = 1 THEN 899 ELSE 1299 END) AS b, least(y + h + 3, CASE WHEN line % 2 = 1 THEN 1299 ELSE 899 END) AS d FROM B),
  m AS (SELECT doc, id, r, texto, CASE r WHEN 0 THEN a WHEN 1 THEN c WHEN 2 THEN 1299 - b ELSE 1299 - d END AS x0, CASE r WHEN 0 THEN b WHEN 1 THEN d WHEN 2 THEN 1299 - a ELSE 1299 - c END AS x1,
    CASE r WHEN 0 THEN c WHEN 1 THEN 899 - b WHEN 2 THEN 899 - d ELSE a END AS y0, CASE r WHEN 0 THEN d WHEN 1 THEN 899 - a WHEN 2 THEN 899 - c ELSE b END AS y1 FROM q WHERE a <= b AND c <= d),
  reach AS (SELECT doc, id, id AS other FROM m UNION
    SELECT reach.doc, reach.id, n.id FROM reach JOIN m o ON o.doc = reach.doc AND o.id = reach.other JOIN m n ON n.doc = o.doc AND n.x0 <= o.x1 + 1 AND o.x0 <= n.x1 + 1 AND n.y0 <= o.y1 + 1 AND o.y0 <= n.y1 + 1),
  root AS (SELECT doc, id, min(other) AS root FROM reach GROUP BY doc, id),
  xs AS (SELECT doc, e AS x, lead(e) OVER (PARTITION BY doc ORDER BY e) AS xe FROM (SELECT doc, x0 AS e FROM m UNION SELECT doc, x1 + 1 FROM m)),
  ys AS (SELECT doc, e AS y, lead(e) OVER (PARTITION BY doc ORDER BY e) AS ye FROM (SELECT doc, y0 AS e FROM m UNION SELECT doc, y1 + 1 FROM m)),
  cell AS (SELECT m.doc, m.id, (xe - x) * (ye - y) AS cells, row_number() OVER (PARTITION BY m.doc, x, y ORDER BY r, m.id DESC) AS k
    FROM m JOIN xs ON xs.doc = m.doc AND x >= x0 AND x <= x1 AND xe IS NOT NULL JOIN ys ON ys.doc = m.doc AND y >= y0 AND y <= y1 AND ye IS NOT NULL),
  seen AS (SELECT doc, id, sum(cells) AS cells FROM cell WHERE k = 1 GROUP BY doc, id)
  SELECT m.doc, arg_min(m.id, lpad(CAST(1000000000 - coalesce(cells, 0) AS VARCHAR), 12, '0') || m.id) AS id, min(x0) AS x, min(y0) AS y, max(x1) - min(x0) + 1 AS w, max(y1) - min(y0) + 1 AS h, count(*) AS n,
    arg_min(texto, lpad(CAST(1000000000 - coalesce(cells, 0) AS VARCHAR), 12, '0') || m.id) AS texto
  FROM m JOIN root ON root.doc = m.doc AND root.id = m.id LEFT JOIN seen ON seen.doc = m.doc AND seen.id = m.id GROUP BY m.doc, root""")
def region_union(spark, d):
    """The boxes as regions of a document of 1300 by 900 cells turned by the quarters of their line."""
    rotation = (F.col("line") % 4).cast("int")
    rows = views.boxes(spark, d).withColumns({"rotation": rotation, "id": F.concat(rotation.cast("string"), F.lit(":"), "key"), "width": F.lit(1300), "height": F.lit(900)})
    return regions.united(rows)

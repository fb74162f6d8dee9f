"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(column, digits: int = 6):
    """Rounded so that engines which add in another order agree."""
    return F.round(column, digits)


#: The views of views.py in SQL.
KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"
L = f"""L AS (
  SELECT {KEY} AS key, l_orderkey AS documento_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, r_name AS fonte,
    CASE WHEN l_returnflag = 'R' THEN n_name END AS tecnica, CASE WHEN l_returnflag = 'R' THEN p_brand END AS gerador, round(l_discount + l_tax, 2) AS score
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
D = "D AS (SELECT doc_id, toxic AS y, source AS fonte, lang AS tecnica, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"
E = "E AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, label % 2 AS fonte, vec_id // 5 AS grupo FROM embeddings)"
G = """G AS (
  SELECT img, i, j, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda z: z * z))), 1e-12)) AS v
  FROM (SELECT vec_id // 25 AS img, CAST((vec_id % 25) // 5 AS INT) AS i, CAST(vec_id % 5 AS INT) AS j, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER (PARTITION BY vec_id // 25) AS n FROM embeddings) WHERE n = 25)"""
V = """V AS (
  SELECT event_id, ts, user_id AS run, CASE event_type WHEN 'signup' THEN 'inicio' WHEN 'view' THEN 'epoca' WHEN 'click' THEN 'epoca' WHEN 'purchase' THEN 'estado_gerador' ELSE 'desconhecido' END AS tipo,
    CAST(json_extract_string(props, '$.k') AS INT) AS epoca, value, event_type FROM events)"""
B = f"""B AS (
  SELECT {KEY} AS key, l_orderkey AS doc, CAST(l_partkey % 1000 AS INT) AS x, CAST(l_suppkey % 500 AS INT) AS y, CAST(l_quantity AS INT) * 10 AS w,
    CAST(round(l_discount * 100) AS INT) * 20 + 10 AS h, p_name AS texto, l_linenumber AS line, l_linenumber % 2 AS block, round(l_tax * 1000) AS conf
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def fold(column: str, folds: int = 5) -> str:
    return f"CAST(CAST('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 8) AS UBIGINT) % {folds} AS INT)"


def hist(source: str, by: str = "", score: str = "score") -> str:
    cols = f"{by}, " if by else ""
    return f"SELECT {cols}{score} AS score, sum(y) AS p, sum(1 - y) AS n FROM {source} WHERE y IS NOT NULL AND {score} IS NOT NULL GROUP BY {cols}{score}"


def auc(histogram: str, by: str = "", digits: int | None = 6) -> str:
    """SQL of by, n_pos, n_neg, auc from a table of by, score, p, n."""
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    area = "sum(p * (below + n / 2.0)) / sum(p) / sum(n)"
    area = f"round({area}, {digits})" if digits is not None else area
    return f"""SELECT {cols}CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, {area} AS auc
      FROM (SELECT {cols}score, p, n, coalesce(sum(n) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {histogram})
      {f'GROUP BY {by} ' if by else ''}HAVING sum(p) > 0 AND sum(n) > 0"""


def held_hist(key: str, same: bool = True, source: str = "L") -> str:
    """SQL of key, score, p, n of each key's positives and their negatives."""
    neg = (
        f"SELECT k.{key}, score, 0 AS p, count(*) AS n FROM {source} JOIN (SELECT DISTINCT {key}, fonte FROM {source} WHERE y = 1 AND {key} <> '') k ON {source}.fonte = k.fonte WHERE y = 0 GROUP BY k.{key}, score"
        if same
        else f"SELECT k.{key}, score, 0 AS p, count(*) AS n FROM {source}, (SELECT DISTINCT {key} FROM {source} WHERE y = 1 AND {key} <> '') k WHERE y = 0 GROUP BY k.{key}, score"
    )
    return f"(SELECT {key}, score, sum(p) AS p, sum(n) AS n FROM (SELECT {key}, score, count(*) AS p, 0 AS n FROM {source} WHERE y = 1 AND {key} <> '' GROUP BY {key}, score UNION ALL {neg}) GROUP BY {key}, score)"


def held_auc(key: str, same: bool = True, source: str = "L", digits: int | None = 6) -> str:
    """SQL of key, n_pos, n_neg, auc with the sign learned from the training rows."""
    value = "CASE WHEN t.s1 - o.s IS NOT NULL AND (t.s1 - o.s) / nullif(t.c1 - o.c, 0) - t.s0 / nullif(t.c0, 0) < 0 THEN 1 - a.auc ELSE a.auc END"
    value = f"round({value}, {digits})" if digits is not None else value
    return f"""SELECT a.{key}, a.n_pos, a.n_neg, {value} AS auc
      FROM ({auc(held_hist(key, same, source), key, None)}) a
      JOIN (SELECT {key}, sum(score) AS s, count(*) AS c FROM {source} WHERE y = 1 AND {key} <> '' GROUP BY {key}) o ON a.{key} = o.{key}
      CROSS JOIN (SELECT sum(score) FILTER (y = 1) AS s1, count(*) FILTER (y = 1) AS c1, sum(score) FILTER (y = 0) AS s0, count(*) FILTER (y = 0) AS c0 FROM {source}) t"""


def balanced(source: str, ident: str) -> str:
    """SQL of the rows of a source after balancing."""
    return f"""SELECT * EXCLUDE (_rank, _least) FROM (
      SELECT *, row_number() OVER (PARTITION BY fonte, y ORDER BY md5(CAST({ident} AS VARCHAR)), {ident}) AS _rank,
        least(count(*) FILTER (y = 1) OVER (PARTITION BY fonte), count(*) FILTER (y = 0) OVER (PARTITION BY fonte)) AS _least FROM {source}) WHERE _rank <= _least"""

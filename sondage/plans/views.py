"""The driver tables as samples, vectors, grids, events, boxes and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..sources.files import table


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Labelled samples: line items with the region of their supplier as source, its nation as
    technique and the part's brand as generator of positives."""
    li, s, n, r, p = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region", "part"))
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(p, li.l_partkey == p.p_partkey)
    y = (F.col("l_returnflag") == "R").cast("int")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return joined.select(
        key.alias("key"), F.col("l_orderkey").alias("documento_id"), y.alias("y"), F.col("r_name").alias("fonte"),
        F.when(y == 1, F.col("n_name")).alias("tecnica"), F.when(y == 1, F.col("p_brand")).alias("gerador"),
        F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("score"),
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents, scored by their length."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id").select("doc_id", F.col("toxic").alias("y"), F.col("source").alias("fonte"), F.col("lang").alias("tecnica"), F.col("n_chars").alias("score"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"), (F.col("label") % 2).alias("fonte"), F.floor(F.col("vec_id") / 5).cast("long").alias("grupo"))


def grids(spark: SparkSession, d: str) -> DataFrame:
    """Full 5 x 5 grids of patch vectors."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).cast("long").alias("img"), (F.floor(F.col("vec_id") % 25 / 5)).cast("int").alias("i"), (F.col("vec_id") % 5).cast("int").alias("j"), F.col("embedding").alias("v"))
    full = e.groupBy("img").agg(F.count(F.lit(1)).alias("_n")).where("_n = 25").select("img")
    return e.join(full, "img")


def run_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    tipo = F.when(kind == "signup", "inicio").when(kind.isin("view", "click"), "epoca").when(kind == "purchase", "estado_gerador").otherwise("desconhecido")
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run"), tipo.alias("tipo"), F.get_json_object("props", "$.k").cast("int").alias("epoca"), "value", "event_type")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of documents with their place in the document."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return li.join(p, li.l_partkey == p.p_partkey).select(
        key.alias("key"), F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 1000).cast("int").alias("x"), (F.col("l_suppkey") % 500).cast("int").alias("y"),
        (F.col("l_quantity").cast("int") * 10).alias("w"), (F.round(F.col("l_discount") * 100).cast("int") * 20 + 10).alias("h"),
        F.col("p_name").alias("texto"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 2).alias("block"), F.round(F.col("l_tax") * 1000, 0).alias("conf"),
    )


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Eleven-digit ids made from customer keys, half of them with a wrong last digit."""
    nine = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    good = fields.with_check_digits(nine)
    off = (F.substring(good, 11, 1).cast("int") + F.when(F.col("c_custkey") % 2 == 1, 1).otherwise(0)) % 10
    return table(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.substring(good, 1, 10), off.cast("string")).alias("cpf"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a log of changes by (l_orderkey, l_linenumber)."""
    li = table(spark, d, "lineitem")
    return li.withColumns({"l_shipdate": F.col("l_shipdate").cast("timestamp"), "price": F.round(F.col("l_extendedprice") * 100).cast("long")}).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "price", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


CHANGE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "price", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

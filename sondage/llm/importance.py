"""Importance resampling: documents are drawn by how much likelier the target makes their features.

Features are the runs of one to three words, dealt by CRC-32 to a fixed number of buckets. Counts of
the buckets in all documents and in the whole target give each bucket a gain, the logarithm of its
share in the target over its share in the documents, in thousandths and with one added to each count.
The weight of a document is the sum of the gains of its features; a Gumbel number made from its id is
added, so that the highest scores are a sample without replacement in proportion to exp(weight).

Higher-order functions make the bucket array of a document and add up elements of one array literal
of all gains, so that scoring is a narrow pass that neither explodes nor joins. Only count totals
are shuffled, of which a task has one for each bucket at most. The draw sorts (score, doc_id) in ranges
that Spark splits by a sample and numbers rows by their range's offset: no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import checkpoint

BUCKETS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All of ASCII but letters and digits parts words.
_BETWEEN = "".join(chr(k) for k in range(128) if not chr(k).isalnum())


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lowered; none of a null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def featured(frame: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`frame` (with text) with _own (words) and _buckets: the bucket of each run of one to three words, repeats included."""
    number = lambda x: F.crc32(x) % buckets
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    less = lambda k: F.greatest(F.size("_own") - k, F.lit(0))
    two = F.zip_with(F.slice("_own", 1, less(1)), F.slice("_own", 2, less(1)), joined)
    three = F.zip_with(F.slice("_two", 1, less(2)), F.slice("_own", 3, less(2)), joined)
    out = frame.withColumn("_own", words(F.col("text"))).withColumn("_two", two)
    return out.withColumn("_buckets", F.concat(*[F.transform(x, number) for x in (F.col("_own"), F.col("_two"), three)])).drop("_two")


def bucket_counts(frame: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of the buckets that occur in the texts; a row with a null bucket counts texts without any."""
    # explode() would have Spark make a filter of the whole feature expression, evaluated many times over
    own = featured(frame.select("text"), buckets).select(F.explode_outer("_buckets").alias("bucket"))
    return own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), where all
    documents hold S features, s of them in the bucket, and the target T and t. `buckets` rows
    come to the driver."""
    spark = documents.sparkSession
    counts = bucket_counts(documents, buckets).withColumnRenamed("n", "s")
    counts = spark.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left")
    counts = counts.join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = checkpoint(counts)
    total = rows.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(total[0] + buckets)) / ((s + 1) * F.lit(float(total[1] + buckets)))
    return [r[0] for r in rows.orderBy("bucket").select(F.floor(1000 * F.log(ratio)).cast("long")).collect()]


def scored(documents: DataFrame, gain: list[int], seed: int = 42) -> DataFrame:
    """`documents` with n_words, n_features, weight and score, all long, in one narrow pass.

    A null text is an empty one: no words, no features, weight 0. A null doc_id counts as empty in the
    random number's text `<seed>:<doc_id>`. A very long text is read as a whole, in time linear in its
    length. Rows are independent: repeated rows give equal results. Columns of these names are replaced, others
    pass through whatever their names; an empty table gives no rows.
    """
    added_names = ["n_words", "n_features", "weight", "score"]
    columns = [c for c in documents.columns if c not in added_names]
    buckets = len(gain)
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # Catalyst folds it to one array literal
    added = F.aggregate("_buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, (b + 1).cast("int")))
    id_text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(id_text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    out = featured(documents.select("doc_id", "text", F.struct(*columns).alias("_row")), buckets)
    out = out.withColumns({"n_words": F.size("_own").cast("long"), "n_features": F.size("_buckets").cast("long"), "weight": added})
    return out.withColumn("score", F.col("weight") + noise).select(*[F.col("_row")[c].alias(c) for c in columns], *added_names)


def draw(rows: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """`rows` (as scored() gives them) with rank (long): 1, 2, 3 ... for the floor(percent N / 100) highest
    scores of the N rows with at least `least_words` words, ties to the smaller doc_id (null last); null for all others.

    The rows are written to the shared folder first, so select the columns that are wanted before. Rows
    that are equal in score and doc_id rank in an order of their own. A column rank is replaced, others pass through
    whatever their names; an empty table gives no rows.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c != "rank"]
    rows = checkpoint(rows.select("doc_id", "n_words", "score", F.struct(*columns).alias("_row")))
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one file of rows for each range, so that a row's place in its range stays as it is
    ranges = checkpoint(rows.where(fit).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = ranges.withColumn("_at", F.monotonically_increasing_id())  # range << 33 | place in the range
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range: at most spark.sql.shuffle.partitions rows
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    ranked = placed.join(F.broadcast(offsets), "_range")
    place = F.col("_before") + F.col("_place") + 1
    drawn = F.floor(F.col("_all") * percent / 100)
    ranked = ranked.select("_row", F.when(place <= drawn, place).cast("long").alias("rank"))
    both = ranked.unionByName(rows.where(~fit).select("_row", F.lit(None).cast("long").alias("rank")))
    return both.select(*[F.col("_row")[c].alias(c) for c in columns], "rank")


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """`documents` with n_words, n_features, weight, score and rank, against the texts of `target`."""
    return draw(scored(documents, gains(documents, target, buckets), seed), percent, least_words)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, resampled towards the whole benchmark."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gain = gains(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = draw(scored(documents, gain).select("doc_id", "n_words", "n_features", "weight", "score"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT b, 0 AS k, CAST(b AS UBIGINT) AS c FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
texts AS (
  SELECT 0 AS target, row_number() OVER () AS ord, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (
  SELECT target, ord, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
f AS MATERIALIZED (
  SELECT target, ord, unnest(list_concat(w, list_concat(
    list_transform(range(1, greatest(len(w), 1)), lambda i: concat(w[i], ' ', w[i + 1])),
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))))) AS feature
  FROM w),
bytes AS MATERIALIZED (
  SELECT feature, list_transform(range(1, strlen(feature) + 1), lambda i: CAST(CAST(concat('0x', substr(hex(encode(feature)), 2 * i - 1, 2)) AS INTEGER) AS UBIGINT)) AS b
  FROM (SELECT DISTINCT feature FROM f)),
bucket AS MATERIALIZED (
  SELECT feature, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], b), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS INTEGER) AS bucket
  FROM bytes, tab),
fb AS MATERIALIZED (SELECT target, ord, bucket FROM f JOIN bucket USING (feature)),
n AS (
  SELECT r.bucket, count(*) FILTER (WHERE target = 0) AS s, count(*) FILTER (WHERE target = 1) AS t
  FROM range(10000) r(bucket) LEFT JOIN fb ON fb.bucket = r.bucket GROUP BY 1),
gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM n) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM n) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n),
weight AS (SELECT ord, count(*) AS n_features, sum(gain) AS weight FROM fb JOIN gain USING (bucket) WHERE target = 0 GROUP BY 1),
scored AS (
  SELECT w.ord, w.doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(CAST(concat('0x', substr(sha256(concat('42:', CAST(w.doc_id AS VARCHAR))), 1, 8)) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM w LEFT JOIN weight USING (ord) WHERE w.target = 0),
fit AS (SELECT ord, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (5 * n) // 100 THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN fit USING (ord)
"""

"""Quality rules: base limits, then multivariate outliers of each language and source, in DataFrame expressions alone.

Each text gives counts, and the counts a vector of transformed statistics (logarithms of lengths, arcsines of
square roots of shares). For each language and source the minimum-covariance-determinant estimate of centre and
scatter is sought: of the rows, a share `alpha` whose scatter has the least determinant. Three
deterministic starts (medians with scaled quartiles, the correlation of hyperbolic tangents, and that of
spatial signs) are improved by concentration steps, and the least determinant wins. A row whose squared
Mahalanobis distance to its group's estimate exceeds a chi-square quantile is rejected.

A concentration step is one aggregation over all rows: moments are summed for each group, start and narrow
bin of the distance, so that sums over the nearest bins give the next estimate without a sort of rows. Rows of
a group of any size combine before the shuffle. Matrices are inverted as arrays by higher-order functions.
The few counts of a text come from native string and array functions, in one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import checkpoint
from .ann import quantile

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_stops"]
#: Statistic, and the least standard deviation that its scatter is given: smaller differences never make an outlier.
FLOORS = {"length": 0.05, "symbols": 0.05, "repeats": 0.1, "variety": 0.03, "capitals": 0.05, "stops": 0.05}
P = len(FLOORS)
X = [f"_x{k}" for k in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SPACE = r"[\x20\x09-\x0D]+"


def statistics(documents: DataFrame) -> DataFrame:
    """`documents` with the long columns of COUNTS, in one narrow pass.

    n_words, word_chars (code points in words `[^\\x20\\x09-\\x0D]+`), n_symbols (of `#*$%&|<>`), n_dup_lines
    (lines with a word that equal an earlier line), n_repeat_words (words in windows of three words that
    occur twice or more; windows are compared by a chain of 64-bit hashes), n_distinct (different words), n_upper
    (capitals of Latin letters) and n_stops (of `.,;:!?`). A null text counts as empty. A very long text is
    read as a whole, sorted in n log n. Rows are independent: repeated rows give equal counts; an empty
    table gives no rows. Columns of these names are replaced, others pass through whatever their names.
    """
    columns = [c for c in documents.columns if c not in COUNTS]
    text = F.coalesce(F.col("text"), F.lit(""))
    found = lambda kind: (F.size(F.split(text, kind)) - 1).cast("long")  # noqa: E731  single characters of a kind
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    less = F.greatest(F.size("_w") - 2, F.lit(0))
    two = F.zip_with(F.slice("_w", 1, less), F.slice("_w", 2, less), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice("_w", 3, less), lambda h, c: F.xxhash64(h, c))
    out = documents.select("text", F.struct(*columns).alias("_row")).withColumns({"_w": F.array_remove(F.split(text, _SPACE), ""), "_lines": lines})
    out = out.withColumn("_h", three)
    # windows in the order of their hashes: those with an equal neighbour occur twice or more
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    none = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    out = out.withColumn("_o", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    of = lambda k: F.get(F.col("_o"), k)["h"]
    twice = F.filter("_o", lambda x, k: F.coalesce(of(k + 1) == x["h"], F.lit(False)) | F.coalesce(of(k - 1) == x["h"], F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("_at", start, lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n")), lambda s: s["n"])
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)),
        "n_symbols": found(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered,
        "n_distinct": F.size(F.array_distinct("_w")),
        "n_upper": found("[A-ZÀ-ÖØ-Þ]"),
        "n_stops": found("[.,;:!?]"),
    }
    return out.select(*[F.col("_row")[c].alias(c) for c in columns], *[c.cast("long").alias(k) for k, c in counts.items()])


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    """Whether a text is short or more than `most_repeated` percent of its words are in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    share = lambda k, of: F.asin(F.sqrt(F.least((F.col(k) + 0.375) / (of + 0.75), F.lit(1.0))))
    return [
        F.log(chars / n),
        share("n_symbols", chars),
        share("n_repeat_words", n),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")) / F.log(n + 1),
        share("n_upper", chars),
        share("n_stops", chars),
    ]


def _inverse(matrix: Column) -> Column:
    """Of a positive definite matrix (P x P as an array): its inverse, m, and the logarithm of its determinant, d."""
    start = F.struct(matrix.alias("m"), F.lit(0.0).alias("d"))

    def pivot(s: Column, k: Column) -> Column:
        m, by = s["m"], F.get(s["m"], k * (P + 1))

        def cell(v: Column, at: Column) -> Column:
            row, column = F.floor(at / P).cast("int"), at % P
            left, top = F.get(m, row * P + k), F.get(m, k * P + column)
            own = F.when((row == k) & (column == k), 1 / by).when(row == k, v / by).when(column == k, -v / by)
            return own.otherwise(v - left * top / by)

        return F.struct(F.transform(m, cell).alias("m"), (s["d"] + F.log(by)).alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), start, pivot)


def _matrix(cell) -> Column:
    """The array of a symmetric matrix from cell(i, j) for i <= j."""
    return F.array(*[cell(min(i, j), max(i, j)) for i in range(P) for j in range(P)])


def _distance(inverse: str = "inverse", centre: str = "centre") -> Column:
    """Squared Mahalanobis distance of a row's vector."""
    off = [F.col(x) - F.get(centre, F.lit(k)) for k, x in enumerate(X)]
    at = lambda i, j: F.get(inverse, F.lit(i * P + j))
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + off[i] * off[j] * at(i, j) * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _bin(distance: Column) -> Column:
    """Narrow bins of a squared distance: 16 for each doubling."""
    return F.floor(16 * F.log2(F.greatest(F.least(distance, F.lit(1e12)), F.lit(1e-6)))).cast("int")


#: Groups of up to so many rows of estimates (some 400 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 20_000


def _with(rows: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """`rows` with the columns of their group; `count` rows are in `groups`."""
    return rows.join(F.broadcast(groups) if count <= MOST_BROADCAST else groups, "_g")


def _grouped(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """`rows` (lang, source and X) with _g: their language and source if so many as `least` rows have them, else all
    small groups of their language, else all that is left together; and the number of groups."""
    key = lambda level, *c: F.to_json(F.struct(F.lit(level).alias("level"), *c))  # noqa: E731  nulls are left out, empty texts are not
    full, part, rest = key(0, F.col("lang"), F.col("source")), key(1, F.col("lang")), key(2)
    own = rows.groupBy(full.alias("_full"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    small = F.sum(F.when(F.col("_n") < least, F.col("_n")).otherwise(0)).over(Window.partitionBy("_part"))
    group = F.when(F.col("_n") >= least, F.col("_full")).when(small >= least, F.col("_part")).otherwise(rest)
    to = checkpoint(own.select("_full", group.alias("_g")))
    count = to.count()
    to = F.broadcast(to) if count <= MOST_BROADCAST else to
    return rows.withColumn("_full", full).join(to, "_full").drop("_full"), count


def _quartiles(rows: DataFrame) -> DataFrame:
    """_g, _n, and for each coordinate the median (m0, m1 ...) and a scale (s0, s1 ...) from its quartiles, by bins of
    an eighth of its floor."""
    floors = list(FLOORS.values())
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(x) * (8 / floors[k])).alias("b")) for k, x in enumerate(X)]))
    bins = rows.select("_g", cells.alias("c")).groupBy("_g", "c.k", "c.b").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("_g", "k")
    upto, total = F.sum("n").over(own.orderBy("b")), F.sum("n").over(own)
    placed = bins.withColumns({"_upto": upto, "_n": total})
    first = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_n"), F.col("b")))
    per = placed.groupBy("_g", "k").agg(first(0.25).alias("low"), first(0.5).alias("middle"), first(0.75).alias("high"), F.max("_n").alias("_n"))
    width = F.element_at(F.array(*[F.lit(f / 8) for f in floors]), F.col("k") + 1)
    per = per.select("_g", "k", "_n", ((F.col("middle") + 0.5) * width).alias("m"), ((F.col("high") - F.col("low")) * width / 1.349).alias("s"))
    one = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return per.groupBy("_g").agg(F.max("_n").alias("_n"), *[one("m", k).alias(f"m{k}") for k in range(P)], *[one("s", k).alias(f"s{k}") for k in range(P)])


def _estimate(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates of summed moments (w, a0 ... of a coordinate less its old centre, b0_0 ... of products):
    centre, inverse and log_det, floors added to the scatter."""
    floors = list(FLOORS.values())
    mean = lambda k: F.col(f"a{k}") / F.col("w")
    scatter = _matrix(lambda i, j: F.col(f"b{i}_{j}") / F.col("w") - mean(i) * mean(j) + (floors[i] ** 2 if i == j else 0.0))
    out = moments.select(*keys, "_n", F.array(*[F.get("centre", F.lit(k)) + mean(k) for k in range(P)]).alias("centre"), _inverse(scatter).alias("_i"))
    return out.select(*keys, "_n", "centre", F.col("_i")["m"].alias("inverse"), F.col("_i")["d"].alias("log_det"))


def _moments() -> list[Column]:
    off = [F.col(x) - F.get("centre", F.lit(k)) for k, x in enumerate(X)]
    return [F.count(F.lit(1)).alias("w"), *[F.sum(off[k]).alias(f"a{k}") for k in range(P)], *[F.sum(off[i] * off[j]).alias(f"b{i}_{j}") for i, j in _PAIRS]]


_SUMS = ["w", *[f"a{k}" for k in range(P)], *[f"b{i}_{j}" for i, j in _PAIRS]]


def _concentrated(rows: DataFrame, now: DataFrame, count: int, share: float) -> DataFrame:
    """The next estimates: from the nearest bins that hold `share` of a group's rows."""
    met = _with(rows, now.select("_g", "_start", "centre", "inverse"), count)
    bins = met.withColumn("_b", _bin(_distance())).groupBy("_g", "_start", "_b", "centre").agg(*_moments())
    own = Window.partitionBy("_g", "_start")
    nearer = F.coalesce(F.sum("w").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumns({"_nearer": nearer, "_n": F.sum("w").over(own)}).where(F.col("_nearer") < share * F.col("_n"))
    summed = bins.groupBy("_g", "_start", "centre").agg(F.max("_n").alias("_n"), *[F.sum(c).alias(c) for c in _SUMS])
    return checkpoint(_estimate(summed, ["_g", "_start"]))


def _starts(rows: DataFrame, middle: DataFrame, count: int) -> DataFrame:
    """_g, _start, centre and inverse of three deterministic starts."""
    floors = list(FLOORS.values())
    scale = [F.sqrt(F.col(f"s{k}") ** 2 + floors[k] ** 2) for k in range(P)]
    z = [(F.col(x) - F.col(f"m{k}")) / scale[k] for k, x in enumerate(X)]
    met = _with(rows, middle, count).select("_g", *[z[k].alias(f"_z{k}") for k in range(P)])
    size = F.sqrt(F.greatest(sum((F.col(f"_z{k}") ** 2 for k in range(P)), F.lit(0.0)), F.lit(1e-12)))
    kinds = {"h": lambda k: F.tanh(f"_z{k}"), "g": lambda k: F.col(f"_z{k}") / size}
    sums = [F.avg(f(i) * f(j)).alias(f"{name}{i}_{j}") for name, f in kinds.items() for i, j in _PAIRS]
    both = _with(met.groupBy("_g").agg(*sums), middle, count)
    scatter = lambda name: _matrix(lambda i, j: scale[i] * scale[j] * (F.col(f"{name}{i}_{j}") / F.sqrt(F.col(f"{name}{i}_{i}") * F.col(f"{name}{j}_{j}") + 1e-12) * (1.0 if i == j else 0.95) + (0.01 if i == j else 0.0)))
    plain = _matrix(lambda i, j: scale[i] ** 2 if i == j else F.lit(0.0))
    made = F.array(*[F.struct(F.lit(k).alias("_start"), c.alias("c")) for k, c in enumerate([plain, scatter("h"), scatter("g")])])
    out = both.select("_g", F.array(*[F.col(f"m{k}") for k in range(P)]).alias("centre"), F.explode(made).alias("s"))
    return checkpoint(out.select("_g", "s._start", "centre", _inverse(F.col("s.c"))["m"].alias("inverse")))


def estimates(rows: DataFrame, count: int, alpha: float = 0.75, steps: int = 5) -> DataFrame:
    """_g, _n, centre, inverse and scale of each group of `rows` (_g and X): a row's squared distance over `scale` is
    about chi-square distributed with P degrees of freedom, or smaller."""
    now = _starts(rows, checkpoint(_quartiles(rows)), count)
    for _ in range(steps):
        now = _concentrated(rows, now, 3 * count, alpha)
    best = now.groupBy("_g").agg(F.min_by(F.struct("_n", "centre", "inverse"), F.struct("log_det", "_start")).alias("e")).select("_g", "e.*")
    best = checkpoint(best)
    bins = _with(rows, best, count).groupBy("_g", _bin(_distance()).alias("_b")).agg(F.count(F.lit(1)).alias("w"))
    own = Window.partitionBy("_g")
    upto = bins.withColumns({"_upto": F.sum("w").over(own.orderBy("_b")), "_all": F.sum("w").over(own)}).where(F.col("_upto") >= 0.5 * F.col("_all"))
    middle = upto.groupBy("_g").agg(F.pow(F.lit(2.0), (F.min("_b") + 0.5) / 16).alias("_middle"))
    # where floors make most of the scatter, near rows are nearer than that distribution has it: no reason to shrink it
    scale = F.greatest(F.col("_middle") / quantile(0.5, P), F.lit(1.0))
    return checkpoint(best.join(middle, "_g").select("_g", "_n", "centre", "inverse", scale.alias("scale")))


def judged(counted: DataFrame, least_rows: int = 200, alpha: float = 0.75, sure: float = 1 - 1e-6, steps: int = 5, **limits: int) -> DataFrame:
    """`counted` (lang, source and the columns of COUNTS, as statistics() gives them) with base_failed, distance (squared, null
    where base_failed) and kept.

    Rows that fail the base limits teach nothing and are not kept. A row whose group (see _grouped) has fewer than
    `least_rows` rows has no estimate: its distance is null and it is kept. Null and empty languages
    and sources are values of their own. Equal rows get equal verdicts. The rows are written to the shared folder first,
    so select the columns that are wanted before. Columns of the added names are replaced, others pass
    through whatever their names; an empty table gives no rows.
    """
    columns = [c for c in counted.columns if c not in ("base_failed", "distance", "kept")]
    rows = counted.select("lang", "source", F.struct(*columns).alias("_row"), base_failed(**limits).alias("base_failed"), *[v.alias(x) for x, v in zip(X, _vector(), strict=True)])
    rows = checkpoint(rows)
    good, count = _grouped(rows.where(~F.col("base_failed")), least_rows)
    good = checkpoint(good)
    found = estimates(good.select("_g", *X), count, alpha, steps).where(F.col("_n") >= least_rows)
    found = F.broadcast(found) if count <= MOST_BROADCAST else found
    met = good.join(found, "_g", "left").withColumn("distance", _distance() / F.col("scale"))
    limit = quantile(sure, P)
    out = met.withColumn("kept", F.coalesce(F.col("distance") <= limit, F.lit(True)))
    failed = rows.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    added = ["base_failed", "distance", "kept"]
    both = out.select("_row", *added).unionByName(failed.select("_row", *added))
    return both.select(*[F.col("_row")[c].alias(c) for c in columns], *added)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged within their language and source."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = judged(statistics(documents).select("doc_id", "lang", "source", *COUNTS))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))

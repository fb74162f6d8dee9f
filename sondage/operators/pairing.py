"""Joins within documents and pairs of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import fields
from ..functions.fields import once
from ..functions.hashing import hash_rank
from ..storage import checkpoint


def sidecar(items: DataFrame, sidecars: DataFrame, keys: list[str]) -> DataFrame:
    """Every item, with its sidecar's fields where there is one."""
    return items.join(sidecars, keys, "left")


def donors(rows: DataFrame, key: str, kind: str, quota: int, single: int = 21) -> DataFrame:
    """target, place (from 0) and donor: for each row `quota` others of its kind, or of all kinds where
    its own has no other.

    Each target goes round its partners from a place of its own, again and again if they are
    fewer than `quota`; a target with only one partner gets it `single` times at most. Rows are
    numbered in hash order, so a partner is looked up by its number: what comes out is targets
    times quota, and never all pairs of a kind.
    """
    plain = rows.select(F.col(key).alias("k"), F.col(kind).alias("kind"))
    placed = hash_rank(hash_rank(plain, ["kind"], "k", "at"), [], "k", "over")
    sizes = plain.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    total = plain.agg(F.count(F.lit(1)).alias("total"))
    own = placed.join(sizes, placed["kind"].eqNullSafe(sizes["kind"])).select(placed["*"], "n").crossJoin(F.broadcast(total))
    alone = F.col("n") == 1
    count, at = F.when(alone, F.col("total")).otherwise(F.col("n")), F.when(alone, F.col("over")).otherwise(F.col("at")) - 1
    others = count - 1
    wanted = own.where(others > 0).select(F.col("k").alias("target"), F.when(~alone, F.col("kind")).alias("among"), alone.alias("alone"), count.alias("n"), at.alias("at"), F.explode(F.sequence(F.lit(0), F.when(others == 1, min(quota, single)).otherwise(quota) - 1)).alias("place"))
    start = F.conv(F.substring(F.md5(F.concat(F.col("target").cast("string"), F.lit("/"))), 1, 8), 16, 10).cast("long")
    asked = wanted.withColumn("to", (F.col("at") + 1 + F.pmod(start + F.col("place"), F.col("n") - 1)) % F.col("n"))
    within = placed.select(F.lit(False).alias("alone"), F.col("kind").alias("among"), (F.col("at") - 1).alias("to"), F.col("k").alias("donor"))
    overall = placed.select(F.lit(True), F.lit(None).cast(dict(placed.dtypes)["kind"]), F.col("over") - 1, "k")
    there = within.unionAll(overall)
    same = (asked["alone"] == there["alone"]) & asked["among"].eqNullSafe(there["among"]) & (asked["to"] == there["to"])
    return asked.join(there, same).select("target", F.col("place").cast("int").alias("place"), "donor")


def nearest_label(values: DataFrame, labels: DataFrame, doc: str, value_place: list[str], label_name: str, label_place: list[str]) -> DataFrame:
    """Each value of `values` (columns doc, value_place, x, y, w, h) with the name of the nearest
    label of its document by squared distance of centres; the first in `label_place` of equals.

    An equality join on the document, then an aggregation of the nearest, which combines
    before the shuffle; labels of a document are few.
    """
    right = labels.select(F.col(doc), F.struct(*B.SIDES).alias("_l"), F.col(label_name).alias("_name"), F.struct(*label_place).alias("_at"))
    left = values.select(doc, *value_place, F.struct(*B.SIDES).alias("_v"))
    joined = left.join(right, doc).withColumn("_d", B.squared_distance(F.col("_v"), F.col("_l")))
    best = joined.groupBy(doc, *value_place).agg(F.min(F.struct("_d", "_at", "_name")).alias("_b"))
    return best.select(doc, *value_place, F.col("_b._name").alias("label"), F.col("_b._d").alias("distance"))


def bounding(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, x, y, w, h: the smallest box around all boxes of each group."""
    edge = rows.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_x2"), F.max(F.col("y") + F.col("h")).alias("_y2"))
    return edge.select(*by, "x", "y", (F.col("_x2") - F.col("x")).alias("w"), (F.col("_y2") - F.col("y")).alias("h"))


def values_of_labels(words: DataFrame, is_label: Column, doc: str, ident: str, reach: int = 2) -> DataFrame:
    """Regions of the values that belong to label words.

    `words` has doc, ident (unique in a document), block, line, x, y, w, h, texto. For a label
    word the words to its right on its line make one region (kind 0; its top and bottom
    take the label in). Of its block's next `reach` lines each makes a region (kind 1, 2),
    until a line with another label word; lines whose words are all blank are passed over.
    Result: doc, ident of the label, kind, x, y, w, h, n words.
    """
    one = F.struct("line", "x", "y", (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.col(ident).alias("ident"), F.coalesce(is_label, F.lit(False)).alias("stop"), F.coalesce(F.trim("texto") != "", F.lit(False)).alias("some"))
    # a block's words stand in one row; all that follows is within the row
    per = words.groupBy(doc, "block").agg(F.collect_list(one).alias("w")).where(F.exists("w", lambda w: w["stop"]))
    least = lambda ws, side: F.array_min(F.transform(ws, lambda w: w[side]))
    most = lambda ws, side: F.array_max(F.transform(ws, lambda w: w[side]))
    box = lambda ws: {"x": least(ws, "x"), "y": least(ws, "y"), "x2": most(ws, "x2"), "y2": most(ws, "y2"), "n": F.size(ws).cast("long")}
    named = lambda cols: [c.alias(k) for k, c in cols.items()]
    numbers = F.array_sort(F.array_distinct(F.transform("w", lambda w: w["line"])))
    per = per.withColumn("numbers", numbers)
    line = lambda k: once(F.filter("w", lambda w: w["line"] == k), lambda ws: F.struct(*named(box(ws)), F.exists(ws, lambda w: w["stop"]).alias("stop"), F.exists(ws, lambda w: w["some"]).alias("some")))
    per = per.withColumn("lines", F.transform("numbers", line))

    def of(label: Column) -> Column:
        right = F.filter("w", lambda w: (w["line"] == label["line"]) & (w["x"] > label["x2"]))
        taken = lambda ws: F.struct(F.lit(0).alias("kind"), *named(box(ws) | {"y": F.least(least(ws, "y"), label["y"]), "y2": F.greatest(most(ws, "y2"), label["y2"])}))
        same = F.transform(F.filter(F.array(right), lambda ws: F.size(ws) > 0), taken)
        after = F.slice("lines", (F.array_position("numbers", label["line"]) + 1).cast("int"), F.lit(reach))
        below = F.filter(F.transform(after, lambda s, i: F.struct((i + 1).alias("kind"), *[s[c].alias(c) for c in ("x", "y", "x2", "y2", "n", "stop", "some")])), lambda s: s["some"])
        until = F.array_position(F.transform(below, lambda s: s["stop"]), F.lit(True)).cast("int")
        kept = F.when(until > 0, F.slice(below, F.lit(1), F.greatest(until - 1, F.lit(0)))).otherwise(below)
        plain = F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "x", "y", "x2", "y2", "n")]))
        return F.transform(F.concat(same, plain), lambda s: F.struct(label["ident"].alias("label"), *[s[c].alias(c) for c in ("kind", "x", "y", "x2", "y2", "n")]))

    found = per.select(doc, F.explode(F.flatten(F.transform(F.filter("w", lambda w: w["stop"]), of))).alias("r"))
    return found.select(doc, "r.label", "r.kind", "r.x", "r.y", (F.col("r.x2") - F.col("r.x")).alias("w"), (F.col("r.y2") - F.col("r.y")).alias("h"), "r.n")


def axis_vote(rows: DataFrame, doc: str, **more: Column) -> DataFrame:
    """doc, horizontal, vertical and axis: horizontal when at least as many boxes are wide as are not. more: other aggregates, by name."""
    per = rows.groupBy(doc).agg(F.count_if(F.col("w") >= F.col("h")).alias("horizontal"), F.count_if(F.col("w") < F.col("h")).alias("vertical"), *[c.alias(k) for k, c in more.items()])
    return per.withColumn("axis", F.when(F.col("horizontal") >= F.col("vertical"), 0).otherwise(90))


def word_score(words: DataFrame, by: list[str], least: float = 60.0) -> DataFrame:
    """by, score and readable: sum of confidences over words of three letters or more with a
    confidence over 0, and whether it reaches `least`."""
    good = (F.col("conf") > 0) & (F.length(F.regexp_replace("texto", r"[^\p{L}]", "")) >= 3)
    per = words.groupBy(*by).agg(F.sum(F.when(good, F.col("conf")).otherwise(0.0)).alias("score"))
    return per.withColumn("readable", F.col("score") >= least)


def rotation(rows: DataFrame, scores: DataFrame, doc: str, least: float = 60.0) -> DataFrame:
    """doc and rotation (clockwise degrees that set a document upright).

    The boxes' axis leaves two turns; of these the one with the greater reading score wins, the
    smaller turn of equals. A document whose better score is under `least` has no row.
    `scores` has doc, rot and score.
    """
    return _turn(axis_vote(rows, doc).select(doc, "axis"), scores, doc, least)


def _turn(vote: DataFrame, scores: DataFrame, doc: str, least: float) -> DataFrame:
    fitting = scores.join(vote, doc).where(F.col("rot") % 180 == F.col("axis") % 180)
    best = fitting.groupBy(doc).agg(F.min(F.struct((-F.col("score")).alias("s"), "rot")).alias("b"))
    return best.where(-F.col("b.s") >= least).select(doc, F.col("b.rot").alias("rotation"))


def classify_fields(rows: DataFrame, doc: str, place: list[str], keywords: dict[str, Column], label: Column) -> DataFrame:
    """doc, place, tipo and texto of the boxes that hold editable data.

    Boxes no wider than high and label texts are passed over; the others are of the kind
    of their text's form, and a name becomes filiacao when the nearest of the horizontal
    label boxes (`keywords` says which texts make one, by name) is called FILIACAO.
    """
    wide = rows.where(F.col("w") > F.col("h"))
    mark = lambda i, name, test: F.when(test, F.struct(*B.SIDES, F.lit(name).alias("_name"), F.lit(i).alias("_kind"), *[F.col(p).alias(f"_p_{p}") for p in place]))
    # one pass over the boxes for all keywords; tests of texts are dear, and what a generator makes is computed once a row
    labels = wide.select(doc, F.inline(F.array(*[mark(i, name, test) for i, (name, test) in enumerate(keywords.items())]))).where("_name is not null")
    data = wide.select(doc, *place, *B.SIDES, "texto", F.explode(F.array(F.when(~label, fields.shape(F.col("texto"))))).alias("tipo")).where("tipo is not null")
    near = nearest_label(data.where("tipo = 'nome'"), labels, doc, place, "_name", ["_kind", *[f"_p_{p}" for p in place]])
    out = data.join(near.select(doc, *place, F.col("label").alias("_near")), [doc, *place], "left")
    kind = F.when((F.col("tipo") == "nome") & (F.col("_near") == "FILIACAO"), "filiacao").otherwise(F.col("tipo"))
    return out.select(doc, *place, kind.alias("tipo"), "texto")


def load_documents(documents: DataFrame, boxes: DataFrame, scores: DataFrame, doc: str, place: list[str], keywords, label, least: float = 60.0) -> DataFrame:
    """doc, rotation, n_boxes and fields (array of tipo, texto and place) of the documents that can be used.

    `documents` has doc, width and height; a document goes when it has no boxes, when its rotation
    stays undecided, or when none of its upright boxes holds editable data. `keywords` and
    `label` are functions of no arguments that give the tests of classify_fields.
    """
    votes = checkpoint(axis_vote(boxes, doc, n_boxes=F.count(F.lit(1))))
    turned = _turn(votes.select(doc, "axis"), scores, doc, least)
    # small rows that all that follows reads again
    known = checkpoint(documents.join(turned, doc).join(votes.select(doc, "n_boxes"), doc))
    upright = boxes.join(known, doc).withColumn("_b", B.rotate(F.struct(*B.SIDES), F.col("width"), F.col("height"), F.col("rotation")))
    upright = upright.withColumns({s: F.col("_b")[s] for s in B.SIDES}).drop("_b")
    found = classify_fields(upright, doc, place, keywords(), label())
    lists = found.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("tipo", "texto", *place))).alias("fields"))
    return known.select(doc, "rotation", "n_boxes").join(lists, doc).select(doc, "rotation", "n_boxes", "fields")

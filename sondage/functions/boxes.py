"""Geometry of boxes (x, y, w, h)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import once

SIDES = ("x", "y", "w", "h")
#: Fixed value: digits with a sign, and around them what a cast to a number leaves out.
NUMBER = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*$"


def geometry(b: Column) -> dict[str, Column]:
    """Right and bottom edge, area, and the centre both exactly and as whole numbers."""
    x, y, w, h = (b[s] for s in SIDES)
    return {"x2": x + w, "y2": y + h, "area": w.cast("long") * h, "cx": x + w / 2, "cy": y + h / 2, "icx": x + F.floor(w / 2).cast("int"), "icy": y + F.floor(h / 2).cast("int")}


def rotate(b: Column, width: Column, height: Column, angle: Column) -> Column:
    """The box in the frame turned clockwise by 0, 90, 180 or 270 degrees; another angle leaves it."""
    x, y, w, h = (b[s] for s in SIDES)
    box = lambda *v: F.struct(*[c.cast("int").alias(s) for s, c in zip(SIDES, v, strict=True)])
    return F.when(angle == 90, box(height - 1 - (y + h), x, h, w)).when(angle == 180, box(width - 1 - (x + w), height - 1 - (y + h), w, h)).when(angle == 270, box(y, width - 1 - (x + w), h, w)).otherwise(box(x, y, w, h))


def rotate_all(boxes: Column, width: Column, height: Column, angle: Column) -> Column:
    """Every box of an array, turned."""
    return F.transform(boxes, lambda b: rotate(b, width, height, angle))


def clamp(b: Column, width: Column, height: Column) -> Column:
    """The part of the box inside the frame; width and height are never negative."""
    x, y, w, h = (b[s] for s in SIDES)
    x0, y0 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    x1, y1 = F.least(width, x + w), F.least(height, y + h)
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(F.lit(0), x1 - x0).alias("w"), F.greatest(F.lit(0), y1 - y0).alias("h"))


def squared_distance(a: Column, b: Column) -> Column:
    """Between the exact centres of two boxes."""
    p, q = geometry(a), geometry(b)
    return (p["cx"] - q["cx"]) * (p["cx"] - q["cx"]) + (p["cy"] - q["cy"]) * (p["cy"] - q["cy"])


def parse(line: Column) -> Column:
    """Box of an annotation line x,y,w,h,text (the text may hold commas); null for a blank line, a
    header, or coordinates that are not whole numbers."""
    # a cast that fails costs an exception, so what has no digits is not tried
    whole = lambda part: F.when(part.rlike(NUMBER), F.trim(part).try_cast("int"))
    sides = lambda parts: [whole(F.get(parts, F.lit(i))).alias(s) for i, s in enumerate(SIDES)]
    read = once(F.split(line, ",", 5), lambda parts: F.struct(*sides(parts), F.trim(F.get(parts, F.lit(4))).alias("texto")))
    # a blank line has one part, and a header's x is no number
    return once(read, lambda b: F.when(reduce(lambda p, q: p & q, [b[c].isNotNull() for c in (*SIDES, "texto")]), b))

"""Points, lines and rectangles as struct expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def point_add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"])


def point_subtract(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def line(a: Column, b: Column) -> Column:
    return F.struct(a.alias("start"), b.alias("end"))


def rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners in any order; left <= right and top <= bottom come out."""
    return F.struct(F.least(x1, x2).alias("left"), F.greatest(x1, x2).alias("right"), F.least(y1, y2).alias("top"), F.greatest(y1, y2).alias("bottom"))


def clipped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A rectangle cut to the image: x1, y1, x2, y2 (exclusive), n (0 if nothing is left)."""
    x1, y1 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    x2, y2 = F.least(x + w, width), F.least(y + h, height)
    n = F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), n.cast("long").alias("n"))

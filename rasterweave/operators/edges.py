"""Edges from the contrast of two boxes on either side of a pixel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import fisher_signed, fisher_unsigned
from .filters import extrema_x, with_extrema
from .point import normalize, size

Criterion = Callable[[Column, Column, Column, Column, Column], Column]
_AXES = {"v": ("y", "x"), "h": ("x", "y")}


def strip_contrast(df: DataFrame, direction: str, width: int, length: int, *, step: int | None = None, margin: int = 0, criterion: Criterion = fisher_signed) -> DataFrame:
    """img, strip, pos, g: criterion of the boxes of ``length`` before and after
    each place along strips of ``width`` lines ("v": strips of rows, contrast
    along x; "h": strips of columns), where both boxes fit."""
    step = width if step is None else step
    if width < 1 or length < 1 or step < width:
        raise ValueError("box width and length >= 1, step >= box width")
    across, along = _AXES[direction]
    spare = (step - width) // 2
    ends = size(df).select("img", F.col("height" if across == "y" else "width").alias("__n"))
    px = df.join(ends, "img").withColumn("__o", F.col(across) - margin - spare)
    strips = F.expr(f"cast((__n - {2 * margin}) div {step} as int)")
    px = px.withColumn("strip", F.floor(F.col("__o") / step).cast("int")).filter((F.col("__o") >= 0) & (F.col("__o") % step < width) & (F.col("strip") < strips))
    v = F.col("v").cast("long")
    lines = px.groupBy("img", "strip", F.col(along).alias("pos")).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    line = W.partitionBy("img", "strip").orderBy("pos")
    before, after = line.rowsBetween(-length, -1), line.rowsBetween(1, length)
    sums = lines.select("img", "strip", "pos", *[F.sum(c).over(w).alias(c + k) for c in "sq" for w, k in ((before, "1"), (after, "2"))], F.count("*").over(before).alias("n1"), F.count("*").over(after).alias("n2"))
    fit = sums.filter((F.col("n1") == length) & (F.col("n2") == length))
    g = criterion(F.lit(float(width * length)), F.col("s1"), F.col("s2"), F.col("q1"), F.col("q2"))
    return fit.select("img", "strip", "pos", g.alias("g"))


def edges(df: DataFrame, direction: str, width: int, length: int, *, step: int | None = None, margin: int = 0) -> DataFrame:
    """img, strip, pos, strength: extrema of the signed contrast, truncated to a
    signed byte; zeros are left out."""
    g = strip_contrast(df, direction, width, length, step=step, margin=margin)
    found = with_extrema(g, W.partitionBy("img", "strip").orderBy("pos"), "g").filter("__turn")
    strength = F.greatest(F.lit(-128), F.least(F.lit(127), F.col("g").cast("int")))
    return found.select("img", "strip", "pos", strength.alias("strength")).filter("strength != 0")


def painted(strips: DataFrame, direction: str, width: int, *, step: int | None = None, margin: int = 0) -> DataFrame:
    """img, y, x, strength of the pixels that edges of strips cover."""
    step = width if step is None else step
    across, along = _AXES[direction]
    first = F.col("strip") * step + margin + (step - width) // 2
    out = strips.withColumn(across, F.explode(F.sequence(first, first + width - 1)))
    return out.select("img", "y" if across == "y" else F.col("pos").alias("y"), "x" if across == "x" else F.col("pos").alias("x"), F.col("strength").alias("strength"))


def both_painted(df: DataFrame, width: int, length: int) -> DataFrame:
    """df with vs and hs: strengths of vertical and horizontal edges at a pixel, or null."""
    for k in "vh":
        p = painted(edges(df.select("img", "y", "x", "v"), k, width, length), k, width).withColumnRenamed("strength", f"{k}s")
        df = df.join(p, ["img", "y", "x"], "left")
    return df


def edges_to_grey(df: DataFrame, width: int, length: int) -> DataFrame:
    """Edge strengths stretched to 0..255; horizontal edges over vertical ones."""
    out = both_painted(df, width, length).select("img", "y", "x", F.coalesce("hs", "vs", F.lit(0)).alias("v"))
    return normalize(out)


def edges_overlay(df: DataFrame, width: int, length: int) -> DataFrame:
    """The image with edge pixels turned to the far end of grey: vertical edges
    first, then horizontal ones on the result."""
    far = lambda c: F.when(c < 128, 255).otherwise(0)
    v = F.when(F.col("vs").isNotNull(), far(F.col("v"))).otherwise(F.col("v"))
    out = both_painted(df, width, length).withColumn("v", v)
    return out.select("img", "y", "x", F.when(F.col("hs").isNotNull(), far(F.col("v"))).otherwise(F.col("v")).alias("v"))


def response_x(df: DataFrame, length: int, width: int, criterion: Criterion = fisher_unsigned) -> DataFrame:
    """The truncated criterion of strips of ``width`` rows on every row of the
    strip; 0 where a box does not fit, and in the last strip."""
    g = strip_contrast(df, "v", width, length, criterion=criterion).select("img", "strip", F.col("pos").alias("x"), F.col("g").cast("int").alias("g"))
    ends = size(df).select("img", F.expr(f"(height - {width} + {width - 1}) div {width}").alias("__k"))
    out = df.withColumn("strip", F.floor(F.col("y") / width).cast("int")).join(ends, "img").join(g, ["img", "strip", "x"], "left")
    return out.select("img", "y", "x", F.when(F.col("strip") < F.col("__k"), F.coalesce("g", F.lit(0))).otherwise(0).alias("v"))


def edges_x_box(df: DataFrame, length: int, width: int) -> DataFrame:
    """Unsigned response, its extrema along x, stretched to 0..255."""
    return normalize(extrema_x(response_x(df, length, width)))

"""Adaptive thresholds over box statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import deviation
from .integral import box_sums


def _binary(on: Column, invert: bool) -> Column:
    return F.when(on, 0 if invert else 255).otherwise(255 if invert else 0)


def sauvola(df: DataFrame, radius: int, k: float, *, maximum: float | None = None, use_mean: bool = False, invert: bool = False) -> DataFrame:
    """v > floor(m * (1 + k * (d / R - 1))), with R given, or the image's largest
    d, or its mean d.  Where R is 0 the threshold is floor(m)."""
    box = box_sums(df, radius)
    box = box.withColumn("m", F.col("s") / F.col("n")).withColumn("d", deviation(F.col("n"), F.col("s"), F.col("s2")))
    if maximum is not None:
        box = box.withColumn("r", F.lit(float(maximum)))
    else:
        # One row an image; the mean is of rounded terms, so that the order of sums cannot tell.
        r = F.sum(F.round(F.col("d") * 1e6).cast("long")) / F.count("*") / 1e6 if use_mean else F.max("d")
        box = box.join(box.groupBy("img").agg(r.alias("r")), "img")
    ratio = F.when(F.col("r") != 0, F.col("d") / F.col("r")).otherwise(F.lit(1.0))
    t = F.floor(F.col("m") * (F.lit(1.0) + (ratio - 1.0) * float(k)))
    return box.select("img", "y", "x", _binary(F.col("v") > t, invert).alias("v"))


def feng(df: DataFrame, radius: int, multiplier: float = 2.0, *, estimate_min: bool = True, alpha: float = 3.0, invert: bool = False) -> DataFrame:
    """Two boxes, the second multiplier times as wide; the least value is that of
    the first box, or estimated as m - alpha * d."""
    if radius < 1 or multiplier <= 1:
        raise ValueError("radius >= 1 and multiplier > 1")
    first = box_sums(df, radius, low=not estimate_min)
    first = first.withColumn("m", F.col("s") / F.col("n")).withColumn("d", deviation(F.col("n"), F.col("s"), F.col("s2")))
    if estimate_min:
        first = first.withColumn("lo", F.greatest(F.lit(0.0), F.col("m") - F.col("d") * float(alpha)))
    second = box_sums(first.select("img", "y", "x", "v", "m", "d", "lo"), int(multiplier * radius), keep=("v", "m", "d", "lo"))
    a = F.col("d") / F.greatest(F.lit(1.0), deviation(F.col("n"), F.col("s"), F.col("s2")))
    second = second.withColumn("a", a).withColumn("g", F.col("a") * F.col("a"))
    t = F.floor(F.col("m") * 0.88 + F.col("g") * 0.25 * F.col("a") * (F.col("m") - F.col("lo")) + F.col("g") * 0.04 * F.col("lo"))
    return second.select("img", "y", "x", _binary(F.col("v") > t, invert).alias("v"))

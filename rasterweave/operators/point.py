"""Operators that look at one pixel, or at an image's extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.color import byte


def blank(spark: SparkSession, img: str, width: int, height: int, value: int = 0) -> DataFrame:
    """A new image of one value."""
    if width < 1 or height < 1:
        raise ValueError(f"bad size {width} x {height}")
    return spark.range(width * height).select(F.lit(img).alias("img"), F.expr(f"cast(id div {width} as int)").alias("y"), (F.col("id") % width).cast("int").alias("x"), F.lit(value).alias("v"))


def clear(df: DataFrame, value: int = 0) -> DataFrame:
    return df.withColumn("v", F.lit(value))


def threshold(df: DataFrame, t: int) -> DataFrame:
    """255 where v >= t, else 0."""
    return df.withColumn("v", F.when(F.col("v") >= t, 255).otherwise(0))


def roi(df: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """A rectangle with its own origin."""
    if width < 1 or height < 1:
        raise ValueError("an empty region")
    inside = F.col("x").between(dx, dx + width - 1) & F.col("y").between(dy, dy + height - 1)
    return df.filter(inside).withColumn("x", F.col("x") - dx).withColumn("y", F.col("y") - dy)


def pick_channel(df: DataFrame, channel: int) -> DataFrame:
    if channel not in (0, 1, 2):
        raise ValueError(f"channel {channel}")
    return df.select(*[c for c in df.columns if c not in ("c0", "c1", "c2")], F.col(f"c{channel}").alias("v"))


def normalize(df: DataFrame, lo: Column | None = None, hi: Column | None = None, value: str = "v") -> DataFrame:
    """Stretch v to 0..255 between the image's extremes, or given ones; a constant
    image becomes 0.  The extremes are an aggregate of one row an image, joined
    back, so that a large image is not gathered in one task."""
    v = F.col(value)
    if lo is None or hi is None:
        ends = df.groupBy("img").agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
        df = df.join(ends, "img")
        lo, hi = F.col("__lo"), F.col("__hi")
    stretched = F.when(hi > lo, byte(F.lit(256.0) / (hi - lo) * (v - lo))).otherwise(0)
    return df.withColumn(value, stretched).drop("__lo", "__hi")


def scale_down(df: DataFrame) -> DataFrame:
    """Every second pixel of every second row."""
    return df.filter("x % 2 = 0 AND y % 2 = 0").withColumn("x", F.expr("x div 2").cast("int")).withColumn("y", F.expr("y div 2").cast("int"))


def scale_up(df: DataFrame) -> DataFrame:
    """Each pixel becomes four."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    out = df.withColumn("__o", F.explode(offsets))
    return out.withColumn("y", F.col("y") * 2 + F.col("__o.i")).withColumn("x", F.col("x") * 2 + F.col("__o.j")).drop("__o")


def size(df: DataFrame) -> DataFrame:
    """img, width, height: what metadata a pixel table implies."""
    return df.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def rows_of(*keys: str) -> W:
    return W.partitionBy("img", *keys, "y").orderBy("x")


def columns_of(*keys: str) -> W:
    return W.partitionBy("img", *keys, "x").orderBy("y")

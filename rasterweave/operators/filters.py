"""3 x 3 filters and scan-line extrema, each axis by one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .point import columns_of, rows_of


def _binomial(v: Column, line: WindowSpec) -> Column:
    before, after = F.lag(v).over(line), F.lead(v).over(line)
    return F.coalesce(F.shiftright(before, 2) + F.shiftright(v, 1) + F.shiftright(after, 2), v)


def binomial(df: DataFrame, passes: int = 1) -> DataFrame:
    """1-2-1 smoothing of rows, then of columns; taps are floored one by one and
    borders stay."""
    for _ in range(passes):
        for line in (rows_of(), columns_of()):
            df = df.withColumn("v", _binomial(F.col("v"), line))
    return df


def _sobel(df: DataFrame, smooth: WindowSpec, slope: WindowSpec, absolute: bool) -> DataFrame:
    v = F.col("v")
    df = df.withColumn("__s", F.lag(v).over(smooth) + v * 2 + F.lead(v).over(smooth))
    g = F.coalesce(F.lead("__s").over(slope) - F.lag("__s").over(slope), F.lit(0))
    return df.withColumn("v", F.abs(g) if absolute else g).drop("__s")


def sobel_x(df: DataFrame, absolute: bool = False) -> DataFrame:
    """Horizontal gradient; 0 on the border."""
    return _sobel(df, columns_of(), rows_of(), absolute)


def sobel_y(df: DataFrame, absolute: bool = False) -> DataFrame:
    return _sobel(df, rows_of(), columns_of(), absolute)


def with_extrema(df: DataFrame, line: WindowSpec, g: str) -> DataFrame:
    """df with __turn: whether g turns at this place.  Steps that are level keep
    the direction of the last one."""
    df = df.withColumn("__step", F.signum(F.col(g) - F.lag(g).over(line)))
    df = df.withColumn("__way", F.last(F.when(F.col("__step") != 0, F.col("__step")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("__next", F.lead("__step").over(line))
    return df.withColumn("__turn", F.coalesce((F.col("__next") != 0) & (F.col("__next") == -F.col("__way")), F.lit(False))).drop("__step", "__way", "__next")


def _extrema(df: DataFrame, line: WindowSpec) -> DataFrame:
    out = with_extrema(df, line, "v").withColumn("__after", F.lead("v").over(line)).withColumn("__before", F.lag("v").over(line))
    inner = F.col("__before").isNotNull() & F.col("__after").isNotNull() & F.col("__turn")
    return out.withColumn("v", F.when(inner, F.col("__after")).otherwise(0)).drop("__turn", "__after", "__before")


def extrema_x(df: DataFrame) -> DataFrame:
    """The value after each local extremum of a row, at the extremum; else 0."""
    return _extrema(df, rows_of())


def extrema_y(df: DataFrame) -> DataFrame:
    return _extrema(df, columns_of())

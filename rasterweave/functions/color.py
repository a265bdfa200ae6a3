"""Colour conversions as column expressions: (c0, c1, c2) to (c0, c1, c2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the YUV model: row weights and the ranges of U and V.
Y_OF = (0.299, 0.587, 0.114)
U_OF = (-0.14713, -0.28886, 0.436)
V_OF = (0.615, -0.51499, -0.10001)
U_MAX, V_MAX = 0.436, 0.615
R_V, G_U, G_V, B_U = 1.13983, -0.39465, -0.58060, 2.03211
GREY_OF = (0.30, 0.59, 0.11)


def byte(c: Column) -> Column:
    """Truncate, then clamp to 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), c.cast("int")))


def _dot(weights: tuple[float, ...], cols: list[Column]) -> Column:
    first, *rest = [c * w for c, w in zip(cols, weights, strict=True)]
    return sum(rest, first)


def rgb_to_grey(c: list[Column]) -> list[Column]:
    return [byte(_dot(GREY_OF, c))]


def rgb_to_yuv(c: list[Column]) -> list[Column]:
    unit = [x / 255.0 for x in c]
    y, u, v = (_dot(w, unit) for w in (Y_OF, U_OF, V_OF))
    return [byte(y * 255), byte((u + U_MAX) / (2 * U_MAX) * 255), byte((v + V_MAX) / (2 * V_MAX) * 255)]


def yuv_to_rgb(c: list[Column]) -> list[Column]:
    y = c[0] / 255.0
    u = c[1] / 255.0 * (2 * U_MAX) - U_MAX
    v = c[2] / 255.0 * (2 * V_MAX) - V_MAX
    return [byte((y + v * R_V) * 255), byte((y + u * G_U + v * G_V) * 255), byte((y + u * B_U) * 255)]


#: (from, to) -> function of the channel columns.  Other pairs do not exist.
CONVERSIONS = {
    ("grey", "rgb"): lambda c: [c[0], c[0], c[0]],
    ("grey", "yuv"): lambda c: [c[0], F.lit(128), F.lit(128)],
    ("rgb", "grey"): rgb_to_grey,
    ("rgb", "yuv"): rgb_to_yuv,
    ("yuv", "rgb"): yuv_to_rgb,
    ("yuv", "grey"): lambda c: [c[0]],
    ("uyvy", "grey"): lambda c: [c[1]],
    ("yuyv", "grey"): lambda c: [c[0]],
}
CHANNELS = {"grey": ["v"], "rgb": ["c0", "c1", "c2"], "yuv": ["c0", "c1", "c2"], "uyvy": ["c0", "c1"], "yuyv": ["c0", "c1"]}


def convert(df: DataFrame, source: str, target: str) -> DataFrame:
    """Convert a raster's channels; other columns stay.  ("uyvy", "yuv") pairs
    neighbouring columns: U from the even one, V from the odd one."""
    if (source, target) == ("uyvy", "yuv"):
        from pyspark.sql.window import Window as W

        pair = W.partitionBy("img", "y", F.expr("x div 2"))
        u, v = (F.max(F.when(F.col("x") % 2 == k, F.col("c0"))).over(pair) for k in (0, 1))
        return df.select(*[c for c in df.columns if c not in ("c0", "c1")], F.col("c1").alias("c0"), u.alias("c1"), v.alias("c2"))
    if (source, target) not in CONVERSIONS:
        raise NotImplementedError(f"no conversion from {source} to {target}")
    old, new = CHANNELS[source], CHANNELS[target]
    out = CONVERSIONS[source, target]([F.col(c) for c in old])
    return df.select(*[c for c in df.columns if c not in old], *[c.cast("int").alias(n) for c, n in zip(out, new, strict=True)])


def colour(label: Column) -> list[Column]:
    """A repeatable colour of a label: c0, c1, c2."""
    mixed = F.pmod(F.pmod(label, F.lit(16_777_213)) * 2_654_435, F.lit(16_777_213))
    return [F.pmod(F.shiftright(mixed, 8 * i), F.lit(256)).cast("int").alias(f"c{i}") for i in range(3)]

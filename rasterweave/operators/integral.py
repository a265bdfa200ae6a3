"""Summed-area tables, box statistics and statistics of rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import deviation, mean, variance
from .point import columns_of, rows_of, size


def integral(df: DataFrame, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """img, y, x, and for each channel its inclusive prefix sum i1 and that of its
    squares i2 (with a channel suffix where there are several)."""
    upto = W.unboundedPreceding
    names = {c: ("i1", "i2") if len(channels) == 1 else (f"{c}_i1", f"{c}_i2") for c in channels}
    row, col = rows_of().rowsBetween(upto, 0), columns_of().rowsBetween(upto, 0)
    out = df.select("img", "y", "x", *[F.sum(F.col(c).cast("long")).over(row).alias(n[0]) for c, n in names.items()], *[F.sum(F.col(c).cast("long") * F.col(c)).over(row).alias(n[1]) for c, n in names.items()])
    return out.select("img", "y", "x", *[F.sum(n).over(col).alias(n) for pair in names.values() for n in pair])


def box_sums(df: DataFrame, radius: int, keep: tuple[str, ...] = ("v",), low: bool = False) -> DataFrame:
    """n, s, s2 (and least value lo) of the (2 radius + 1)-square around each
    pixel, cut at the border: rows first, then columns."""
    row, col = (line.rangeBetween(-radius, radius) for line in (rows_of(), columns_of()))
    v = F.col("v").cast("long")
    out = df.select("img", "y", "x", *keep, F.count("v").over(row).alias("n"), F.sum(v).over(row).alias("s"), F.sum(v * v).over(row).alias("s2"), *[F.min("v").over(row).alias("lo")] * low)
    return out.select("img", "y", "x", *keep, *[F.sum(c).over(col).cast("long").alias(c) for c in ("n", "s", "s2")], *[F.min("lo").over(col).alias("lo")] * low)


def statistics(n: str = "n", s: str = "s", s2: str = "s2") -> list:
    c = (F.col(n), F.col(s), F.col(s2))
    return [mean(*c[:2]).alias("mean"), variance(*c).alias("variance"), deviation(*c).alias("deviation")]


def rect_sums(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """n, s, s2, mean, variance, deviation of each rectangle (img, rect, x, y, w, h)
    cut to its image, zeros where nothing is left: four corners of the summed-area
    table, whatever the rectangle's area."""
    r = rects.join(size(pixels), "img").withColumns({
        "__x1": F.greatest("x", F.lit(0)), "__y1": F.greatest("y", F.lit(0)),
        "__x2": F.least(F.col("x") + F.col("w"), F.col("width")), "__y2": F.least(F.col("y") + F.col("h"), F.col("height")),
    })
    r = r.filter("w > 0 AND h > 0 AND __x2 > __x1 AND __y2 > __y1")
    corner = lambda y, x, sign: F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(sign).alias("sign"))
    corners = F.explode(F.array(corner("__y2", "__x2", 1), corner("__y1", "__x2", -1), corner("__y2", "__x1", -1), corner("__y1", "__x1", 1)))
    area = ((F.col("__x2") - F.col("__x1")).cast("long") * (F.col("__y2") - F.col("__y1"))).alias("n")
    # Corners beyond the upper and left border are 0 and need no look-up.
    at = r.select("img", "rect", area, corners.alias("k")).select("img", "rect", "n", "k.y", "k.x", "k.sign").filter("y >= 0 AND x >= 0")
    sums = at.join(integral(pixels), ["img", "y", "x"]).groupBy("img", "rect").agg(F.first("n").alias("n"), F.sum(F.col("sign") * F.col("i1")).alias("s"), F.sum(F.col("sign") * F.col("i2")).alias("s2"))
    out = rects.join(sums, ["img", "rect"], "left").na.fill(0, ["n", "s", "s2"])
    return out.select(*rects.columns, "n", "s", "s2", *statistics())


def _dyadic(start: Column, stop: Column, top: int) -> Column:
    """The aligned blocks of 2^level, level at most top, that make up start..stop - 1
    without overlap: at most two a level, and those of the top level between them."""
    ends = []
    for level in range(top):
        lo, hi = F.shiftright(start + ((1 << level) - 1), level), F.shiftright(stop, level)
        for odd, at in ((lo, lo), (hi, hi - 1)):
            ends.append(F.when((lo < hi) & (odd.bitwiseAND(1) == 1), F.struct(F.lit(level).alias("level"), at.cast("int").alias("at"))))
    lo, hi = F.shiftright(start + ((1 << top) - 1), top), F.shiftright(stop, top)
    whole = F.transform(F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>")), lambda at: F.struct(F.lit(top).alias("level"), at.cast("int").alias("at")))
    return F.array_compact(F.concat(F.array(*ends), whole)) if ends else whole


def rect_extremes(pixels: DataFrame, rects: DataFrame, tile: int = 64) -> DataFrame:
    """lo, hi of each rectangle (img, rect, x, y, w, h) cut to its image; zeros where
    nothing is left.  Each different rectangle is cut along both axes into aligned
    blocks whose sides are powers of two, up to the tile (itself rounded up to one),
    and each block is one look-up: some ten of them for a small rectangle.  All sizes
    of blocks together are less than four rows a pixel; only tiles that a rectangle
    touches are made into blocks."""
    top = (tile - 1).bit_length()
    frame = pixels.groupBy("img").agg(*[f(c).cast("long").alias(f"__{n}{c}") for c in ("x", "y") for f, n in ((F.min, "from_"), (F.max, "to_"))])
    shape = ["img", "x", "y", "w", "h"]
    cuts = rects.filter("w > 0 AND h > 0 AND x IS NOT NULL AND y IS NOT NULL").select(*shape).distinct().join(frame, "img")
    span = lambda c, n: _dyadic(F.greatest(F.col(c).cast("long"), F.col(f"__from_{c}")), F.least(F.col(c).cast("long") + F.col(n), F.col(f"__to_{c}") + 1), top)
    cuts = cuts.select(*shape, F.explode(span("x", "w")).alias("bx"), span("y", "h").alias("by")).withColumn("by", F.explode("by"))
    place = [F.expr(f"shiftright(b{c}.at, {top} - b{c}.level)").alias(f"t{c}") for c in ("y", "x")]
    touched = cuts.select("img", *place).distinct()
    px = pixels.select("img", "y", "x", "v", F.shiftright("y", top).alias("ty"), F.shiftright("x", top).alias("tx")).join(touched, ["img", "ty", "tx"], "left_semi")
    block = lambda c: F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(c, k).cast("int").alias("at")) for k in range(top + 1)])).alias(f"b{c}")
    lines = px.select("img", "ty", "tx", "y", block("x"), "v").groupBy("img", "ty", "tx", "y", "bx").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    blocks = lines.select("img", "ty", "tx", "bx", block("y"), "lo", "hi").groupBy("img", "ty", "tx", "bx", "by").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = cuts.join(blocks.drop("ty", "tx"), ["img", "bx", "by"]).groupBy(*shape).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return rects.join(ends, shape, "left").na.fill(0, ["lo", "hi"]).select(*rects.columns, "lo", "hi")


def spatial_rollup(df: DataFrame, sizes: tuple[int, ...] = (16, 8, 4)) -> DataFrame:
    """n, s, s2 of all blocks of several sizes.  The smallest blocks are summed
    from pixels, each larger size from the one below."""
    sizes = tuple(sorted(sizes))
    if any(b % a for a, b in zip(sizes, sizes[1:], strict=False)):
        raise ValueError("each size must divide the next")
    v = F.col("v").cast("long")
    level = df.groupBy("img", F.expr(f"cast(y div {sizes[0]} as int)").alias("by"), F.expr(f"cast(x div {sizes[0]} as int)").alias("bx")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"))
    out = level.withColumn("size", F.lit(sizes[0]))
    for small, big in zip(sizes, sizes[1:], strict=False):
        k = big // small
        level = level.groupBy("img", F.expr(f"cast(by div {k} as int)").alias("by"), F.expr(f"cast(bx div {k} as int)").alias("bx")).agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])
        out = out.unionByName(level.withColumn("size", F.lit(big)))
    return out.select("img", "size", "by", "bx", "n", "s", "s2")

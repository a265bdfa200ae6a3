"""Quad trees: a grid of root trees, divided level by level by aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import colour
from ..functions.stats import deviation, fisher_signed, overlap, value_range
from .edges import strip_contrast
from ..session import cut
from .integral import rect_sums, spatial_rollup, statistics
from .point import size

SUMS = ("n", "s", "s2")


def grid(df: DataFrame, tree: int) -> DataFrame:
    """img, rows, cols, dx, dy of the grid of trees, centred in its image."""
    g = size(df).select("img", "width", "height", F.expr(f"cast(height div {tree} as int)").alias("rows"), F.expr(f"cast(width div {tree} as int)").alias("cols"))
    return g.select("img", "rows", "cols", F.expr(f"cast((width - cols * {tree}) div 2 as int)").alias("dx"), F.expr(f"cast((height - rows * {tree}) div 2 as int)").alias("dy"))


def on_grid(df: DataFrame, tree: int) -> DataFrame:
    """Pixels under the grid, in its coordinates (gy, gx); dx, dy kept."""
    px = df.join(grid(df, tree), "img")
    px = px.withColumn("gy", F.col("y") - F.col("dy")).withColumn("gx", F.col("x") - F.col("dx"))
    return px.filter((F.col("gy") >= 0) & (F.col("gx") >= 0) & (F.col("gy") < F.col("rows") * tree) & (F.col("gx") < F.col("cols") * tree))


def levels(df: DataFrame, largest: int, smallest: int) -> DataFrame:
    """n, s, s2 of every block (img, size, by, bx) from largest to smallest, each half the one before."""
    if smallest < 1 or largest % smallest or (k := largest // smallest) & (k - 1):
        raise ValueError("tree sizes must be a power of two apart")
    sizes = tuple(smallest << i for i in range(k.bit_length()))
    px = on_grid(df, largest).select("img", F.col("gy").alias("y"), F.col("gx").alias("x"), "v")
    return spatial_rollup(px, sizes)


def placed(blocks: DataFrame, df: DataFrame, tree: int) -> DataFrame:
    """img, size, y, x (in pixels), n, s, s2 of blocks of the grid."""
    out = blocks.join(grid(df, tree).select("img", "dx", "dy"), "img")
    return out.select("img", "size", (F.col("by") * F.col("size") + F.col("dy")).cast("int").alias("y"), (F.col("bx") * F.col("size") + F.col("dx")).cast("int").alias("x"), *SUMS)


def roots(df: DataFrame, tree: int) -> DataFrame:
    """Root trees with their statistics."""
    return placed(levels(df, tree, tree), df, tree).select("img", "size", "y", "x", *SUMS, *statistics())


def child_statistics(df: DataFrame, tree: int) -> DataFrame:
    """Statistics of the four children of each root."""
    return placed(levels(df, tree, tree // 2).filter(F.col("size") == tree // 2), df, tree).select("img", "size", "y", "x", *SUMS, *statistics())


def neighbourhood(df: DataFrame, tree: int, multiplier: float) -> DataFrame:
    """Statistics of the box of each root, grown by multiplier times its size."""
    grow = int(multiplier * tree)
    r = placed(levels(df, tree, tree), df, tree)
    rects = r.select("img", (F.col("y").cast("long") * (1 << 32) + F.col("x")).alias("rect"), (F.col("x") - grow).alias("x"), (F.col("y") - grow).alias("y"), F.lit(tree + 2 * grow).alias("w"), F.lit(tree + 2 * grow).alias("h"))
    out = rect_sums(df, rects)
    return out.select("img", (F.col("y") + grow).alias("y"), (F.col("x") + grow).alias("x"), *SUMS, "mean", "variance", "deviation")


Test = Callable[[DataFrame, DataFrame], DataFrame]


def by_deviation(limit: float) -> Test:
    """Divide blocks whose deviation is above the limit."""
    def test(level: DataFrame, children: DataFrame) -> DataFrame:
        d = deviation(F.col("n"), F.col("s"), F.col("s2"))
        return level.filter(d > limit).select("img", "by", "bx")
    return test


def by_overlap(alpha: float, limit: float) -> Test:
    """Divide blocks whose four children's value ranges overlap below the limit."""
    def test(level: DataFrame, children: DataFrame) -> DataFrame:
        n, s, s2 = (F.col(c) for c in SUMS)
        lo, hi = value_range(s / n, deviation(n, s, s2), alpha)
        c = children.select("img", F.expr("cast(by div 2 as int)").alias("by"), F.expr("cast(bx div 2 as int)").alias("bx"), lo.alias("lo"), hi.alias("hi"))
        c = c.groupBy("img", "by", "bx").agg(F.min("lo").alias("a"), F.max("lo").alias("b"), F.min("hi").alias("c"), F.max("hi").alias("d"))
        return c.filter(overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")) < limit).select("img", "by", "bx")
    return test


def divide(df: DataFrame, largest: int, smallest: int, test: Test) -> DataFrame:
    """Leaves (img, size, y, x, n, s, s2): blocks that exist and are not divided.
    As many steps as levels; the blocks of all levels, a small table next to the
    pixels, are summed and stored once."""
    every = cut(levels(df, largest, smallest))
    here = every.filter(F.col("size") == largest)
    leaves, at = None, largest
    while at >= 2 * smallest:
        below = every.filter(F.col("size") == at // 2)
        child = below.withColumn("py", F.expr("cast(by div 2 as int)")).withColumn("px", F.expr("cast(bx div 2 as int)"))
        open_ = here.select("img", F.col("by").alias("py"), F.col("bx").alias("px"))
        split = test(here, child.join(open_, ["img", "py", "px"], "left_semi").drop("py", "px"))
        stay = here.join(split, ["img", "by", "bx"], "left_anti")
        leaves = stay if leaves is None else leaves.unionByName(stay)
        parents = split.select("img", F.col("by").alias("py"), F.col("bx").alias("px"))
        here = child.join(parents, ["img", "py", "px"], "left_semi").drop("py", "px")
        at //= 2
    leaves = here if leaves is None else leaves.unionByName(here)
    return placed(leaves, df, largest)


def unit_cells(leaves: DataFrame, unit: int) -> DataFrame:
    """One row a unit cell of each leaf: cy, cx in pixels."""
    return leaves.withColumn("cy", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("size") - unit, F.lit(unit)))).withColumn("cx", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("size") - unit, F.lit(unit))))


def leaf_neighbours(leaves: DataFrame, unit: int) -> DataFrame:
    """img, ay, ax, asize, by, bx, bsize, side: leaves b that touch a's east ("E")
    or south ("S") side.  Sides are cut into unit cells, so this is an equi-join."""
    out = None
    for side, (far, along) in {"E": ("x", "y"), "S": ("y", "x")}.items():
        step = F.explode(F.sequence(F.col(along), F.col(along) + F.col("size") - unit, F.lit(unit)))
        a = leaves.select("img", F.col("y").alias("ay"), F.col("x").alias("ax"), F.col("size").alias("asize"), (F.col(far) + F.col("size")).alias("f"), step.alias("u"))
        b = leaves.select("img", F.col("y").alias("by"), F.col("x").alias("bx"), F.col("size").alias("bsize"), F.col(far).alias("f"), step.alias("u"))
        pairs = a.join(b, ["img", "f", "u"]).select("img", "ay", "ax", "asize", "by", "bx", "bsize", F.lit(side).alias("side")).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


def draw_means(df: DataFrame, leaves: DataFrame, largest: int, unit: int) -> DataFrame:
    """Each pixel under a leaf gets the leaf's mean."""
    cells = unit_cells(leaves, unit).select("img", "cy", "cx", (F.col("s") / F.col("n")).cast("int").alias("m"))
    px = on_grid(df, largest).select("img", "y", "x", (F.col("y") - F.col("gy") % unit).alias("cy"), (F.col("x") - F.col("gx") % unit).alias("cx"))
    return px.join(cells, ["img", "cy", "cx"]).select("img", "y", "x", F.col("m").alias("v"))


def draw_image(df: DataFrame, leaves: DataFrame, largest: int, unit: int, segments: bool = False, colours: bool = False) -> DataFrame:
    """img, y, x, c0, c1, c2 of the whole image: the mean of each pixel's leaf, or
    with segments that of its segment (leaves have segment), or with colours the
    segment's colour; 0 where no leaf is."""
    mean = F.col("s") / F.col("n")
    if segments or colours:
        sums = leaves.groupBy("img", "segment").agg(*[F.sum(c).alias(c) for c in SUMS])
        leaves = leaves.drop(*SUMS).join(sums, ["img", "segment"])
    paint = colour(F.col("segment")) if colours else [mean.cast("int").alias(f"c{i}") for i in range(3)]
    cells = unit_cells(leaves, unit).select("img", "cy", "cx", *paint)
    px = df.select("img", "y", "x").join(grid(df, largest).select("img", "dy", "dx"), "img")
    px = px.select("img", "y", "x", *[(F.col(k) - F.pmod(F.col(k) - F.col(f"d{k}"), F.lit(unit))).alias(f"c{k}") for k in "yx"])
    return px.join(cells, ["img", "cy", "cx"], "left").select("img", "y", "x", *[F.coalesce(F.col(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(3)])


def highlight(rgb: DataFrame, leaves: DataFrame, wanted: DataFrame, largest: int, unit: int, paint: tuple[int, int, int]) -> DataFrame:
    """rgb (img, y, x, c0, c1, c2) with one colour on all pixels of the wanted
    segments (img, segment) of leaves (with segment)."""
    mine = unit_cells(leaves.join(wanted.select("img", "segment"), ["img", "segment"], "left_semi"), unit).select("img", "cy", "cx", F.lit(True).alias("__in"))
    px = rgb.join(grid(rgb, largest).select("img", "dy", "dx"), "img")
    px = px.select(*rgb.columns, *[(F.col(k) - F.pmod(F.col(k) - F.col(f"d{k}"), F.lit(unit))).alias(f"c{k}") for k in "yx"])
    out = px.join(mine, ["img", "cy", "cx"], "left")
    return out.select("img", "y", "x", *[F.when(F.col("__in"), v).otherwise(F.col(f"c{i}")).alias(f"c{i}") for i, v in enumerate(paint)])


def links8(df: DataFrame, tree: int) -> DataFrame:
    """img, ay, ax, by, bx, angle: undirected links of roots with their E, SE, S and
    SW neighbours (upper left corners), angle of the way from a to b in [0, 2 pi):
    0 to the east, counter-clockwise."""
    r = placed(levels(df, tree, tree), df, tree).select("img", "y", "x")
    ways = F.array(*[F.struct(F.lit(dy * tree).alias("dy"), F.lit(dx * tree).alias("dx")) for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1))])
    a = r.select("img", F.col("y").alias("ay"), F.col("x").alias("ax"), F.explode(ways).alias("o"))
    a = a.select("img", "ay", "ax", (F.col("ay") + F.col("o.dy")).alias("y"), (F.col("ax") + F.col("o.dx")).alias("x"), F.col("o.dy").alias("dy"), F.col("o.dx").alias("dx"))
    angle = F.atan2(-F.col("dy").cast("double"), F.col("dx").cast("double"))
    angle = F.when(angle < 0, angle + 2 * 3.141592653589793).otherwise(F.abs(angle))
    return a.join(r, ["img", "y", "x"]).select("img", "ay", "ax", F.col("y").alias("by"), F.col("x").alias("bx"), angle.alias("angle"))


def link_lines(df: DataFrame, tree: int) -> DataFrame:
    """Links as lines between tree centres, with the difference of means as weight."""
    r = roots(df, tree)
    k = links8(df, tree)
    a = r.select("img", F.col("y").alias("ay"), F.col("x").alias("ax"), F.col("mean").alias("ma"))
    b = r.select("img", F.col("y").alias("by"), F.col("x").alias("bx"), F.col("mean").alias("mb"))
    out = k.join(a, ["img", "ay", "ax"]).join(b, ["img", "by", "bx"])
    c = lambda n: (F.col(n) + tree // 2).alias({"ax": "x1", "ay": "y1", "bx": "x2", "by": "y2"}[n])
    return out.select("img", c("ax"), c("ay"), c("bx"), c("by"), F.abs(F.col("ma") - F.col("mb")).alias("weight"))


def tree_edges(df: DataFrame, tree: int, largest: int | None = None) -> DataFrame:
    """img, r, c, dx, dy, mag, ang of every tree of the grid (or of virtual
    children, where tree is smaller than the grid's own size): mean signed
    contrast over the tree's columns and rows, 0 where boxes do not fit."""
    largest = largest or tree
    length = max(tree // 2, 4)
    g = grid(df, largest)
    out = None
    for k, (across, along) in {"v": ("y", "x"), "h": ("x", "y")}.items():
        off, rest = ("dy", "dx") if k == "v" else ("dx", "dy")
        count, others = ("rows", "cols") if k == "v" else ("cols", "rows")
        px = df.join(g, "img").withColumn(across, F.col(across) - F.col(off)).filter((F.col(across) >= 0) & (F.col(across) < F.col(count) * largest)).select("img", "y", "x", "v")
        fit = strip_contrast(px, k, tree, length, criterion=fisher_signed)
        fit = fit.join(g, "img").withColumn("__at", F.floor((F.col("pos") - F.col(rest)) / tree).cast("int")).filter((F.col("pos") >= F.col(rest)) & (F.col("__at") < F.col(others) * (largest // tree)))
        r, c = ("strip", "__at") if k == "v" else ("__at", "strip")
        name = "dx" if k == "v" else "dy"
        m = fit.groupBy("img", F.col(r).alias("r"), F.col(c).alias("c")).agg((F.sum(F.round(F.col("g") * 1e9).cast("long")) / 1e9 / tree).alias(name))
        out = m if out is None else out.join(m, ["img", "r", "c"], "full")
    cells = levels(df, largest, tree).filter(F.col("size") == tree).select("img", F.col("by").alias("r"), F.col("bx").alias("c"), *SUMS)
    out = cells.join(out, ["img", "r", "c"], "left").na.fill(0.0, ["dx", "dy"])
    ang = F.atan2("dx", "dy")
    return out.select("img", "r", "c", *SUMS, "dx", "dy", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("mag"), F.when(ang < 0, ang + 2 * 3.141592653589793).otherwise(ang).alias("ang"))

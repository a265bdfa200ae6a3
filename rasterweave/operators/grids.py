"""Operators on grids of trees (img, r, c): propagation, edge trees, edge segments,
min-sum parsing of the neighbour graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import value_range
from ..session import cut
from .components import merge_labels
from .quadtree import grid


def _near(v: Column, own: Column) -> dict[str, Column]:
    """The share of v that comes from each side; a border sends a tree's own back."""
    rows, cols = W.partitionBy("img", "r").orderBy("c"), W.partitionBy("img", "c").orderBy("r")
    return {k: F.coalesce(f(v).over(w), own) for k, f, w in (("W", F.lag, rows), ("E", F.lead, rows), ("N", F.lag, cols), ("S", F.lead, cols))}


def propagate(df: DataFrame, values: tuple[str, ...], rounds: int, way: str = "N4") -> DataFrame:
    """Spread values over neighbours: half stays, an eighth comes from each side.

    "N4" keeps the total; "H" and "V" take two sides only and lose a quarter a
    round; "M" sends by the direction of dx, dy.  All rounds are one plan."""
    if way not in ("N4", "H", "V", "M"):
        raise ValueError(f"propagation {way}")
    for _ in range(rounds):
        if way == "M":
            whole = F.abs("dx") + F.abs("dy")
            mx, my = (F.when(whole < 0.01, 0.5).otherwise(F.abs(c) / whole) for c in ("dx", "dy"))
            for c in values:
                df = df.withColumn("__ns", mx * F.col(c) / 4).withColumn("__ew", my * F.col(c) / 4)
                ns, ew = _near(F.col("__ns"), F.col("__ns")), _near(F.col("__ew"), F.col("__ew"))
                df = df.withColumn(c, F.col(c) / 2 + ns["N"] + ew["E"] + ns["S"] + ew["W"]).drop("__ns", "__ew")
        else:
            sides = {"N4": "NESW", "H": "EW", "V": "NS"}[way]
            new = {}
            for c in values:
                near = _near(F.col(c), F.col(c))
                new[c] = sum((near[s] / 8 for s in sides), F.col(c) / 2)
            df = df.withColumns(new)
    return df


def stands_out(df: DataFrame, value: Column, rounds: int, bias: float) -> DataFrame:
    """df with pm, pd (mean and deviation of the value after propagation) and
    stands: value > max(pm, pm + bias - pd)."""
    df = df.withColumn("__v", value.cast("double")).withColumn("__a", F.col("__v")).withColumn("__b", F.col("__v") * F.col("__v"))
    df = propagate(df, ("__a", "__b"), rounds)
    d = F.sqrt(F.greatest(F.lit(0.0), F.col("__b") - F.col("__a") * F.col("__a")))
    df = df.withColumn("pm", F.col("__a")).withColumn("pd", d)
    return df.withColumn("stands", F.col("__v") > F.greatest(F.col("pm"), F.col("pm") + float(bias) - F.col("pd"))).drop("__a", "__b", "__v")


def find_edges(trees: DataFrame, rounds: int, bias: float, way: str = "N4") -> DataFrame:
    """Trees (with dx, dy, mag) and has_edge: dy for "H", dx for "V", else mag."""
    value = F.col({"H": "dy", "V": "dx"}.get(way, "mag"))
    return stands_out(trees, value, rounds, bias).withColumnRenamed("stands", "has_edge")


def segment_edges(trees: DataFrame, rounds: int, bias: float, way: str, spread: int, limit: float, merge: str) -> DataFrame:
    """img, r, c, segment of trees with an edge: edges spread by constant 10 a
    tree, those above the limit join, and edge trees that touch along ``merge``
    ("H", "V" or "N4") are one segment (its least tree, r * 2**32 + c)."""
    found = find_edges(trees, rounds, bias, way).withColumn("__e", F.when(F.col("has_edge"), 10.0).otherwise(0.0))
    found = propagate(found, ("__e",), spread, way if way in ("H", "V") else "M")
    on = cut(found.filter(F.col("has_edge") | (F.col("__e") > limit)).select("img", "r", "c", (F.col("r").cast("long") * (1 << 32) + F.col("c")).alias("id")))
    pairs = None
    for way_, (dr, dc) in (("H", (0, 1)), ("V", (1, 0))):
        if merge in (way_, "N4"):
            other = on.select("img", (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("id").alias("b"))
            p = on.join(other, ["img", "r", "c"]).select("img", F.col("id").alias("a"), "b")
            pairs = p if pairs is None else pairs.union(p)
    labels = merge_labels(pairs).withColumnRenamed("node", "id")
    return on.join(labels, ["img", "id"], "left").select("img", "r", "c", F.coalesce("label", "id").alias("segment"))


def segment_list(segments: DataFrame, trees: DataFrame, size: int) -> DataFrame:
    """img, segment, n, s, s2, y1, x1, y2, x2 of segments, from the sums of their trees
    (boxes in grid pixels, inclusive)."""
    j = segments.join(trees.select("img", "r", "c", "n", "s", "s2"), ["img", "r", "c"])
    return j.groupBy("img", "segment").agg(*[F.sum(k).cast("long").alias(k) for k in ("n", "s", "s2")], (F.min("r") * size).alias("y1"), (F.min("c") * size).alias("x1"), (F.max("r") * size + size - 1).alias("y2"), (F.max("c") * size + size - 1).alias("x2"))


def segment_trees(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Trees of the wanted segments (img, segment)."""
    return segments.join(wanted.select("img", "segment"), ["img", "segment"], "left_semi")


def segment_neighbours(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """img, segment: segments that touch a wanted one, without the wanted ones."""
    mine = segment_trees(segments, wanted)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    near = mine.select("img", "r", "c", around.alias("o")).select("img", (F.col("r") + F.col("o.r")).alias("r"), (F.col("c") + F.col("o.c")).alias("c"))
    return segments.join(near, ["img", "r", "c"]).select("img", "segment").distinct().join(wanted.select("img", "segment"), ["img", "segment"], "left_anti")


def segment_mask(pixels: DataFrame, segments: DataFrame, wanted: DataFrame, size: int, invert: bool = False) -> DataFrame:
    """255 on pixels of wanted segments, else 0 (or the other way round), over the
    least box of grid trees that holds them all, with its own origin."""
    mine = segment_trees(segments, wanted).select("img", "r", "c", F.lit(True).alias("__in"))
    box = mine.groupBy("img").agg(*[f(k).alias(f"__{k}{i}") for k in "rc" for i, f in ((1, F.min), (2, F.max))])
    at = pixels.select("img", "y", "x").join(grid(pixels, size).select("img", "dy", "dx"), "img").join(box, "img")
    at = at.withColumn("r", F.floor((F.col("y") - F.col("dy")) / size).cast("int")).withColumn("c", F.floor((F.col("x") - F.col("dx")) / size).cast("int"))
    at = at.filter("r BETWEEN __r1 AND __r2 AND c BETWEEN __c1 AND __c2")
    on, off = (0, 255) if invert else (255, 0)
    own = [(F.col(k) - F.col(d) - F.col(f"__{t}1") * size).alias(k) for k, d, t in (("y", "dy", "r"), ("x", "dx", "c"))]
    return at.join(mine, ["img", "r", "c"], "left").select("img", *own, F.when(F.col("__in"), on).otherwise(off).alias("v"))


def boundaries(trees: DataFrame, rounds: int, bias: float) -> DataFrame:
    """Trees with devmean, devdev and has_boundary: the test on the tree's deviation."""
    n, s, s2 = (F.col(c) for c in ("n", "s", "s2"))
    d = F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s / n) * (s / n)))
    out = stands_out(trees.withColumn("mean", s / n).withColumn("deviation", d), d, rounds, bias)
    return out.withColumnRenamed("pm", "devmean").withColumnRenamed("pd", "devdev").withColumnRenamed("stands", "has_boundary")


#: Which neighbours a chain may go on to, by class of direction: (dr, dc) for the
#: next and the previous tree, in order of preference.
_N, _NE, _E, _SE, _S, _SW, _W, _NW = (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)
DIRECTIONS = {
    "steep": ([_N], [_S]),
    "flat": ([_W], [_E]),
    "same-wide": ([_N, _NE, _E], [_S, _SW, _W]),
    "same": ([_N, _NE], [_S, _SW]),
    "opposite-wide": ([_W, _NW, _N], [_E, _SE, _S]),
    "opposite": ([_NW, _N], [_SE, _S]),
}


def direction_class(dx: Column, dy: Column) -> Column:
    same = dx * dy > 0
    wide = F.abs(dx) < F.abs(dy) * 2
    steeper = F.abs(dx) > F.abs(dy)
    return F.when(steeper & (dy == 0), "steep").when(~steeper & (dx == 0), "flat").when(same & wide, "same-wide").when(same, "same").when(wide, "opposite-wide").otherwise("opposite")


def _steps() -> Column:
    """Class of direction -> the places looked at (side, p, dr, dc)."""
    return F.create_map(*[x for k, sides in DIRECTIONS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(side).alias("side"), F.lit(p).alias("p"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for side, ways in zip(("next", "prev"), sides, strict=True) for p, (dr, dc) in enumerate(ways)]))])


def _looked_at(trees: DataFrame) -> DataFrame:
    """img, r, c, side, p, nr, nc: the places each tree's direction points to."""
    a = trees.select("img", "r", "c", F.explode(_steps()[direction_class(F.col("dx"), F.col("dy"))]).alias("o"))
    return a.select("img", "r", "c", "o.side", "o.p", (F.col("r") + F.col("o.dr")).alias("nr"), (F.col("c") + F.col("o.dc")).alias("nc"))


def _agreeing(found: DataFrame) -> DataFrame:
    """_looked_at() of boundary trees, where another one with dx and dy of the same
    signs stands; with its strength."""
    b = found.filter("has_boundary").select("img", "r", "c", "dx", "dy", F.signum("dx").alias("sx"), F.signum("dy").alias("sy"), F.col("devdev").alias("strength"))
    a = _looked_at(b).join(b.select("img", "r", "c", "sx", "sy"), ["img", "r", "c"])
    n = b.select("img", F.col("r").alias("nr"), F.col("c").alias("nc"), "sx", "sy", "strength")
    return a.join(n, ["img", "nr", "nc", "sx", "sy"]).select("img", "r", "c", "side", "p", "nr", "nc", "strength")


def chain_links(found: DataFrame) -> DataFrame:
    """img, r, c, side ("next", "prev"), nr, nc: the strongest neighbour of each
    boundary tree in its direction whose dx and dy have the same signs."""
    best = F.max_by(F.struct("nr", "nc"), F.struct("strength", -F.col("p")))
    return _agreeing(found).groupBy("img", "r", "c", "side").agg(best.alias("b")).select("img", "r", "c", "side", "b.nr", "b.nc")


def extended_boundaries(found: DataFrame, low_factor: float) -> DataFrame:
    """Boundaries grown along their direction: where no boundary tree stands on a
    side, the tree there of the greatest deviation above low_factor times the own
    one joins, and looks for more; all that join in a round do so at once."""
    own = found.select("img", "r", "c", "dx", "dy", "deviation", "has_boundary")
    fresh = own.filter("has_boundary")
    while True:
        n = own.select("img", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("deviation").alias("nd"), F.col("has_boundary").alias("nb"))
        near = _looked_at(fresh).join(fresh.select("img", "r", "c", "deviation"), ["img", "r", "c"]).join(n, ["img", "nr", "nc"])
        strong = F.when(~F.col("nb") & (F.col("nd") > F.col("deviation") * float(low_factor)), F.struct("nd", -F.col("p"), "nr", "nc"))
        sides = near.groupBy("img", "r", "c", "side").agg(F.max("nb").alias("nb"), F.max(strong).alias("b")).filter("NOT nb AND b IS NOT NULL")
        new = cut(sides.select("img", F.col("b.nr").alias("r"), F.col("b.nc").alias("c")).distinct().withColumn("__new", F.lit(True)))
        if new.isEmpty():
            return found.drop("has_boundary").join(own.select("img", "r", "c", "has_boundary"), ["img", "r", "c"])
        own = cut(own.join(new, ["img", "r", "c"], "left").withColumn("has_boundary", F.col("has_boundary") | F.coalesce("__new", F.lit(False))).drop("__new"))
        fresh = own.join(new.drop("__new"), ["img", "r", "c"], "left_semi")


def strong_boundaries(found: DataFrame, low_factor: float = 0.5, extend: bool = False) -> DataFrame:
    """has_boundary only where a boundary tree with dx and dy of the same signs
    stands in the tree's direction.  Trees are judged in order (row by row): one
    that is dropped no longer supports those after it.  With extend, boundaries
    are first grown by extended_boundaries(); low_factor matters only then."""
    if extend:
        found = cut(extended_boundaries(found, low_factor))
    near = cut(_agreeing(found).select("img", "r", "c", "nr", "nc"))
    later = F.struct("nr", "nc") > F.struct("r", "c")
    # A later neighbour is not judged yet; an earlier one supports if it is kept.
    kept = cut(near.filter(later).select("img", "r", "c").distinct())
    earlier, fresh = cut(near.filter(~later)), kept
    while True:
        by = fresh.select("img", F.col("r").alias("nr"), F.col("c").alias("nc"))
        fresh = cut(earlier.join(by, ["img", "nr", "nc"]).select("img", "r", "c").distinct().join(kept, ["img", "r", "c"], "left_anti"))
        if fresh.isEmpty():
            break
        kept = cut(kept.union(fresh))
    ok = kept.withColumn("__ok", F.lit(True))
    return found.join(ok, ["img", "r", "c"], "left").withColumn("has_boundary", F.col("has_boundary") & F.coalesce("__ok", F.lit(False))).drop("__ok")


def heads(trees: DataFrame) -> DataFrame:
    """Both heads of each 8-neighbour link: img, r, c, tr, tc, angle (of the way
    from the tree to the other one, 0 to the east, counter-clockwise), cost (of
    the half-step: low along the tree's own edge, and between flat trees)."""
    ways = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in (_N, _NE, _E, _SE, _S, _SW, _W, _NW)]))
    a = trees.select("img", F.col("r").alias("ar"), F.col("c").alias("ac"), F.col("ang").alias("aa"), F.col("deviation").alias("ad"), F.col("devmean").alias("am"), F.col("devdev").alias("av"), ways.alias("o"))
    a = a.select("*", (F.col("ar") + F.col("o.dr")).alias("r"), (F.col("ac") + F.col("o.dc")).alias("c"))
    j = a.join(trees.select("img", "r", "c", F.col("deviation").alias("bd"), F.col("devmean").alias("bm"), F.col("devdev").alias("bv")), ["img", "r", "c"])
    pi = 3.141592653589793
    angle = F.atan2(-F.col("o.dr").cast("double"), F.col("o.dc").cast("double"))
    j = j.withColumn("angle", F.when(angle < 0, angle + 2 * pi).otherwise(F.abs(angle)))
    half = lambda c: F.when(c > pi, c - pi).otherwise(c)
    turn = F.abs(half(F.col("angle")) - half(F.col("aa")))
    fold = F.when(turn > pi / 2, F.lit(pi) - turn).otherwise(turn)
    calm = (F.col("ad") < F.col("am")) & (F.col("bd") < F.col("bm"))
    cost = F.when(calm, F.greatest(F.lit(0.0), F.col("am") - F.abs(F.col("ad") - F.col("bd")))).otherwise(fold / (pi / 2) * F.abs(F.col("av") - F.col("bv")))
    cost = F.when(cost < 1e-7, 0.001).otherwise(cost)
    return j.select("img", F.col("ar").alias("r"), F.col("ac").alias("c"), F.col("r").alias("tr"), F.col("c").alias("tc"), "angle", cost.alias("cost"))


def parse(trees: DataFrame, rounds: int, bias: float) -> DataFrame:
    """img, r, c, tr, tc, strength of links between active trees: min-sum messages
    over the neighbour graph.  Trees whose deviation stands out (after rounds + 1
    propagations) are active first; each round their neighbours join.  A round
    pools, at each head of an active tree, its own half-step cost and the best
    path that came in by another head; then both ends of a link swap them.
    strength is 1 - (s - min) / (max - min) over s = summed cost / summed length."""
    found = cut(boundaries(trees, rounds + 1, bias))
    h = cut(heads(found))
    place, keys = ["img", "r", "c"], ["img", "r", "c", "tr", "tc"]
    active = cut(found.filter("has_boundary").select(*place))
    state = h.select(*keys, F.lit(0.0).alias("acc"), F.lit(0).alias("len")).limit(0)
    tree = W.partitionBy(*place)
    for _ in range(rounds):
        joined = h.join(active, place, "left_semi").select("img", F.col("tr").alias("r"), F.col("tc").alias("c"))
        active = cut(active.union(joined).distinct())
        # Paths of length 0 are none.
        s = h.join(active, place, "left_semi").join(state, keys, "left").select(*keys, "cost", F.coalesce("acc", F.lit(0.0)).alias("acc"), F.coalesce("len", F.lit(0)).alias("len"))
        s = s.withColumn("k", F.row_number().over(tree.orderBy(F.when(F.col("len") > 0, 0).otherwise(1), "acc", "tr", "tc")))
        best = lambda k, c: F.max(F.when((F.col("k") == k) & (F.col("len") > 0), F.col(c))).over(tree)
        s = s.withColumns({"a1": best(1, "acc"), "l1": best(1, "len"), "a2": best(2, "acc"), "l2": best(2, "len")})
        pick = lambda i: F.coalesce(F.when((F.col("k") == 1) & (F.col("len") > 0), F.col(f"{i}2")).otherwise(F.col(f"{i}1")), F.lit(0))
        s = s.withColumn("pool", F.col("cost") + pick("a")).withColumn("plen", pick("l"))
        other = s.select("img", F.col("tr").alias("r"), F.col("tc").alias("c"), F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("pool").alias("opool"), F.col("plen").alias("olen"))
        live = F.col("opool").isNotNull()
        state = cut(s.join(other, keys, "left").select(*keys, F.when(live, F.col("cost") + F.col("opool")).otherwise(F.col("acc")).alias("acc"), F.when(live, F.col("olen") + 1).otherwise(F.col("len")).cast("int").alias("len")))
    back = state.select("img", F.col("tr").alias("r"), F.col("tc").alias("c"), F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("acc").alias("bacc"), F.col("len").alias("blen"))
    both = state.join(back, keys).filter(F.struct("r", "c") < F.struct("tr", "tc"))
    both = cut(both.select(*keys, ((F.col("acc") + F.col("bacc")) / (F.col("len") + F.col("blen"))).alias("s")))
    ends = both.groupBy("img").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return both.join(ends, "img").select(*keys, F.when(F.col("hi") > F.col("lo"), 1 - (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("strength"))


def parse_boundaries(trees: DataFrame, rounds: int) -> DataFrame:
    """Trees with has_boundary where a tree's own value range (mean and deviation)
    and that of its surroundings (mean after rounds propagations, deviation after
    one more) share less than half of what they span."""
    n, s, s2 = (F.col(c) for c in ("n", "s", "s2"))
    t = trees.withColumn("mean", s / n).withColumn("deviation", F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s / n) * (s / n))))
    t = propagate(t.withColumn("pm", F.col("mean")), ("pm",), rounds)
    t = propagate(t.withColumn("dm", F.col("deviation")), ("dm",), rounds + 1)
    a, b = value_range(F.col("pm"), F.col("dm"), 1.0), value_range(F.col("mean"), F.col("deviation"), 1.0)
    shared, span = F.least(a[1], b[1]) - F.greatest(a[0], b[0]), F.greatest(a[1], b[1]) - F.least(a[0], b[0])
    return t.withColumn("has_boundary", F.when(span > 0, F.greatest(F.lit(0.0), shared) / span < 0.5).otherwise(False))

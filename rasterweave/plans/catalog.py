"""All raster queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry, stats
from ..operators import adaptive, components, edges, filters, grids, integral, lists, point, quadtree, sequential, temporal
from ..session import cut, shared_dir
from ..sources import fixtures
from ..sources.fixtures import table
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def pixels(name: str, source: str, op: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    """A query that applies op to a fixture; img is one constant and left out."""
    query(name, oracle and sql.over(source, oracle))(lambda spark, sf: op(getattr(fixtures, source)(spark, sf)).drop("img"))


# Point operators -----------------------------------------------------------
pixels("threshold", "emb_grey", lambda d: point.threshold(d, 120), "SELECT y, x, CASE WHEN v >= 120 THEN 255 ELSE 0 END AS v FROM px")
pixels("roi", "emb_grey", lambda d: point.roi(d, 8, 100, 32, 200), "SELECT y - 100 AS y, x - 8 AS x, v FROM px WHERE x BETWEEN 8 AND 39 AND y BETWEEN 100 AND 299")
pixels("scale_down", "emb_grey", point.scale_down, "SELECT y // 2 AS y, x // 2 AS x, v FROM px WHERE x % 2 = 0 AND y % 2 = 0")
pixels("scale_up", "emb_grey", point.scale_up, "SELECT y * 2 + i AS y, x * 2 + j AS x, v FROM px, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)")
pixels("normalize", "emb_grey", point.normalize, sql.NORMALIZE.format(src="px"))
pixels("normalize_given", "emb_grey", lambda d: point.normalize(d, F.lit(50), F.lit(200)), "SELECT y, x, least(255, greatest(0, trunc(256.0::DOUBLE / (200 - 50) * (v - 50))))::INT AS v FROM px")
pixels("channel_pick", "emb_rgb", lambda d: point.pick_channel(d, 1), "SELECT y, x, c1 AS v FROM px")
pixels("doc_threshold", "doc_bytes", lambda d: point.threshold(d, 110).groupBy("y").agg(F.count(F.when(F.col("v") == 255, 1)).alias("bright"), F.count("*").alias("width")), "SELECT y, count(*) FILTER (v >= 110) AS bright, count(*) AS width FROM px GROUP BY y")


@query("image_size", sql.over("emb_grey", "SELECT 'emb' AS img, max(x) + 1 AS width, max(y) + 1 AS height FROM px"))
def _image_size(spark: SparkSession, sf: str) -> DataFrame:
    return point.size(fixtures.emb_grey(spark, sf))


@query("blank", "SELECT (i // 40)::INT AS y, (i % 40)::INT AS x, 7 AS v FROM range(1200) t(i)")
def _blank(spark: SparkSession, sf: str) -> DataFrame:
    return point.blank(spark, "new", 40, 30, 7).drop("img")


@query("rect_norm", sql.RECT_NORM)
def _rect_norm(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    corner = [F.col(c).cast("int") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    r = geometry.rect(*corner)
    return o.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[r[k].alias(k) for k in ("left", "right", "top", "bottom")])


@query("points", "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS sx, l_linenumber - l_orderkey AS dy FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)")
def _points(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    a, b = geometry.point(F.col("l_partkey"), F.col("l_linenumber")), geometry.point(F.col("l_suppkey"), F.col("l_orderkey"))
    ln = geometry.line(geometry.point_add(a, b), geometry.point_subtract(a, b))
    return o.select("l_orderkey", "l_linenumber", ln["start"]["x"].alias("sx"), ln["end"]["y"].alias("dy"))


# Colour ----------------------------------------------------------------------
pixels("grey_to_rgb", "emb_grey", lambda d: color.convert(d, "grey", "rgb"), "SELECT y, x, v AS c0, v AS c1, v AS c2 FROM px")
pixels("grey_to_yuv", "emb_grey", lambda d: color.convert(d, "grey", "yuv"), "SELECT y, x, v AS c0, 128 AS c1, 128 AS c2 FROM px")
pixels("rgb_to_grey", "emb_rgb", lambda d: color.convert(d, "rgb", "grey"), "SELECT y, x, trunc(c0 * 0.30::DOUBLE + c1 * 0.59::DOUBLE + c2 * 0.11::DOUBLE)::INT AS v FROM px")
pixels("rgb_to_yuv", "emb_rgb", lambda d: color.convert(d, "rgb", "yuv"), sql.RGB_TO_YUV)
pixels("yuv_to_rgb", "emb_rgb", lambda d: color.convert(d, "yuv", "rgb"), sql.YUV_TO_RGB)
pixels("yuv_to_grey", "emb_rgb", lambda d: color.convert(d, "yuv", "grey"), "SELECT y, x, c0 AS v FROM px")
pixels("uyvy_to_grey", "emb_uyvy", lambda d: color.convert(d, "uyvy", "grey"), "SELECT y, x, c1 AS v FROM px")
pixels("yuyv_to_grey", "emb_uyvy", lambda d: color.convert(d, "yuyv", "grey"), "SELECT y, x, c0 AS v FROM px")
pixels("uyvy_to_yuv", "emb_uyvy", lambda d: color.convert(d, "uyvy", "yuv"), "SELECT a.y, a.x, a.c1 AS c0, u.c0 AS c1, w.c0 AS c2 FROM px a JOIN px u ON u.y = a.y AND u.x = a.x - a.x % 2 JOIN px w ON w.y = a.y AND w.x = a.x - a.x % 2 + 1")

# Filters -----------------------------------------------------------------------
pixels("binomial_1", "emb_grey", lambda d: filters.binomial(d, 1), sql.binomial(1))
pixels("binomial_2", "emb_grey", lambda d: filters.binomial(d, 2), sql.binomial(2))
for _n, _f in (("sobel_x", filters.sobel_x), ("sobel_y", filters.sobel_y)):
    pixels(_n, "emb_grey", _f, sql.sobel(_n[-1], False))
    pixels("abs_" + _n, "emb_grey", lambda d, f=_f: f(d, absolute=True), sql.sobel(_n[-1], True))
pixels("extrema_x", "emb_grey", filters.extrema_x, sql.extrema("px", "y", "x"))
pixels("extrema_y", "emb_grey", filters.extrema_y, sql.extrema("px", "x", "y"))

# Statistics ----------------------------------------------------------------------
pixels("integral", "emb_grey", integral.integral, sql.integral({"v": ("i1", "i2")}))
pixels("integral_multichannel", "emb_rgb", lambda d: integral.integral(d, ("c0", "c1", "c2")), sql.integral({c: (f"{c}_i1", f"{c}_i2") for c in ("c0", "c1", "c2")}))
pixels("box_stats", "emb_grey", lambda d: integral.box_sums(d, 3), sql.BOX)


def _rects(spark: SparkSession, sf: str) -> DataFrame:
    """One rectangle a customer, some beyond the image."""
    c = table(spark, sf, "customer").select("c_custkey")
    k = F.col("c_custkey").cast("int")
    return c.select(F.lit("emb").alias("img"), k.alias("rect"), (k % 70 - 4).alias("x"), (k * 7 % 520 - 10).alias("y"), (k % 13).alias("w"), (k % 17).alias("h"))


for _n, _cols in {"rect_mean": ("mean",), "rect_variance": ("variance",), "rect_stats": ("n", "s", "s2", "mean", "variance", "deviation"), "rect_min": ("lo",), "rect_max": ("hi",)}.items():
    def _one(spark: SparkSession, sf: str, cols: tuple[str, ...] = _cols) -> DataFrame:
        op = integral.rect_extremes if cols[0] in ("lo", "hi") else integral.rect_sums
        out = op(fixtures.emb_grey(spark, sf), _rects(spark, sf))
        return out.select("rect", *[F.round(c, 6).alias(c) if c in ("mean", "variance", "deviation") else F.col(c) for c in cols])

    query(_n, sql.over("emb_grey", sql.rects(_cols)))(_one)


@query("rect_clip", sql.over("emb_grey", sql.RECT_CLIP))
def _rect_clip(spark: SparkSession, sf: str) -> DataFrame:
    r = _rects(spark, sf).join(point.size(fixtures.emb_grey(spark, sf)), "img")
    cut = geometry.clipped(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return r.select("rect", *[cut[k].alias(k) for k in ("x1", "y1", "x2", "y2", "n")])


pixels("spatial_rollup", "emb_grey", integral.spatial_rollup, "SELECT k AS size, y // k AS by, x // k AS bx, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS s2 FROM px, (VALUES (4), (8), (16)) t(k) GROUP BY ALL")

# Adaptive thresholds ---------------------------------------------------------------
pixels("sauvola_fixed", "emb_grey", lambda d: adaptive.sauvola(d, 3, 0.3, maximum=128), sql.sauvola("128.0::DOUBLE"))
pixels("sauvola_max", "emb_grey", lambda d: adaptive.sauvola(d, 3, 0.3), sql.sauvola("(SELECT max(d) FROM dev)"))
pixels("sauvola_mean", "emb_grey", lambda d: adaptive.sauvola(d, 3, 0.3, use_mean=True, invert=True), sql.sauvola("(SELECT sum(round(d * 1e6)::BIGINT)::BIGINT / count(*) / 1e6 FROM dev)", True))
pixels("feng_est", "emb_grey", lambda d: adaptive.feng(d, 2, 2.0), sql.feng(True))
pixels("feng_min", "emb_grey", lambda d: adaptive.feng(d, 2, 2.0, estimate_min=False), sql.feng(False))


@query("entry", sql.over("emb_grey", sql.feng(True, inverted=True, tail="SELECT y, count(*) FILTER (v = 255) AS dark, count(*) AS width FROM out GROUP BY y")))
def _entry(spark: SparkSession, sf: str) -> DataFrame:
    """The first steps of the threshold program: dark pixels a row."""
    out = adaptive.feng(fixtures.emb_grey(spark, sf), 2, 2.0, invert=True)
    return out.groupBy("y").agg(F.count(F.when(F.col("v") == 255, 1)).alias("dark"), F.count("*").alias("width"))


# Edges -------------------------------------------------------------------------------
def _contrast(criterion: edges.Criterion, direction: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: edges.strip_contrast(d, direction, 4, 6, criterion=criterion).withColumn("g", F.round("g", 6))


pixels("fisher_signed", "emb_check", _contrast(stats.fisher_signed, "v"), sql.contrast("v", "signed", "SELECT strip, pos, round(g, 6) AS g FROM g"))
pixels("fisher_unsigned", "emb_check", _contrast(stats.fisher_unsigned, "h"), sql.contrast("h", "unsigned", "SELECT strip, pos, round(g, 6) AS g FROM g"))
pixels("edge_response_x", "emb_check", lambda d: edges.response_x(d, 6, 4), sql.RESPONSE)
pixels("edges_v", "emb_check", lambda d: edges.edges(d, "v", 4, 6), sql.contrast("v", "signed", sql.EDGES))
pixels("edges_h", "emb_check", lambda d: edges.edges(d, "h", 4, 6), sql.contrast("h", "signed", sql.EDGES))
pixels("edges_to_grey", "emb_check", lambda d: edges.edges_to_grey(d, 4, 6), sql.PAINT_GREY)
pixels("edges_overlay", "emb_check", lambda d: edges.edges_overlay(d, 4, 6), sql.PAINT_OVER)
pixels("edges_x_box", "emb_check", lambda d: edges.edges_x_box(d, 6, 4), sql.EDGES_X_BOX)
pixels("find_edges_program", "emb_check", lambda d: edges.edges_overlay(filters.binomial(d, 2), 4, 6), sql.FIND_EDGES_PROGRAM)

# Components ----------------------------------------------------------------------------
pixels("cc_labels", "emb_grey", lambda d: components.component_labels(point.threshold(d, 120)), sql.CC + "SELECT r.y, p.x::INT AS x, l.label FROM runs r JOIN lab l USING (id), unnest(range(x1, x2 + 1)) p(x)")
pixels("cc_regions", "emb_grey", lambda d: components.component_regions(point.threshold(d, 120)), sql.CC + sql.CC_REGIONS)
pixels("cc_border", "emb_grey", lambda d: components.border(point.threshold(d, 120)), sql.BORDER)
pixels("cc_draw", "emb_grey", lambda d: components.draw_components(point.threshold(d, 120)), sql.CC_DRAW)


@query("cc_program", sql.over("emb_grey", sql.CC_PROGRAM))
def _cc_program(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold program: adaptive threshold, then regions."""
    return components.component_regions(adaptive.feng(fixtures.emb_grey(spark, sf), 2, 2.0, invert=True)).drop("img")


# Quad trees ------------------------------------------------------------------------------
def rounded(d: DataFrame, *names: str) -> DataFrame:
    return d.withColumns({n: F.round(n, 6) + 0.0 for n in names})


pixels("roots", "emb_check", lambda d: rounded(quadtree.roots(d, 16), "mean", "variance", "deviation"), sql.blocks(16, 16))
pixels("child_stats", "emb_check", lambda d: rounded(quadtree.child_statistics(d, 16), "mean", "variance", "deviation"), sql.blocks(16, 8))
pixels("neighborhood_stats", "emb_check", lambda d: rounded(quadtree.neighbourhood(d, 16, 0.5), "mean", "variance", "deviation"), sql.NEIGHBOURHOOD)
pixels("split_deviation", "emb_check", lambda d: quadtree.divide(d, 16, 4, quadtree.by_deviation(18.0)), sql.split("deviation") + sql.LEAVES)
pixels("split_overlap", "emb_check", lambda d: quadtree.divide(d, 16, 4, quadtree.by_overlap(3.0, 0.5)), sql.split("overlap") + sql.LEAVES)


def _leaves(d: DataFrame) -> DataFrame:
    return cut(quadtree.divide(d, 16, 4, quadtree.by_overlap(3.0, 0.5)))


pixels("leaf_neighbors", "emb_check", lambda d: quadtree.leaf_neighbours(_leaves(d), 4), sql.split("overlap") + sql.LEAF_NEIGHBOURS)
pixels("draw_tree_mean", "emb_check", lambda d: quadtree.draw_means(d, _leaves(d), 16, 4), sql.split("overlap") + sql.DRAW)
pixels("draw_image_mean", "emb_check", lambda d: quadtree.draw_image(d, _leaves(d), 16, 4), sql.split("overlap") + sql.DRAW_IMAGE)


def _segmented(d: DataFrame) -> DataFrame:
    """Leaves, each with its root's place as its segment."""
    segment = F.expr("(y - pmod(y - dy, 16)) * 4294967296 + x - pmod(x - dx, 16)")
    return _leaves(d).join(quadtree.grid(d, 16).select("img", "dx", "dy"), "img").withColumn("segment", segment).drop("dx", "dy")


pixels("draw_image_segments", "emb_check", lambda d: quadtree.draw_image(d, _segmented(d), 16, 4, segments=True), sql.split("overlap") + sql.DRAW_SEGMENTS)
pixels("draw_image_colours", "emb_check", lambda d: quadtree.draw_image(d, _segmented(d), 16, 4, colours=True), sql.split("overlap") + sql.DRAW_COLOURS)


def _highlighted(d: DataFrame) -> DataFrame:
    s = _segmented(d)
    wanted = s.filter("size = 4").select("img", "segment").distinct()
    return quadtree.highlight(color.convert(d, "grey", "rgb"), s, wanted, 16, 4, (250, 120, 0))


pixels("highlight_segments", "emb_check", _highlighted, sql.split("overlap") + sql.HIGHLIGHT)
pixels("links8", "emb_check", lambda d: rounded(quadtree.links8(d, 16), "angle"), sql.LINKS + "SELECT ay, ax, links.\"by\", bx, round(angle, 6) + 0.0 AS angle FROM links")
pixels("links_lines", "emb_check", lambda d: rounded(quadtree.link_lines(d, 16), "weight"), sql.LINKS + 'SELECT ax + 8 AS x1, ay + 8 AS y1, bx + 8 AS x2, links."by" + 8 AS y2, round(abs(a.s / a.n - b.s / b.n), 6) + 0.0 AS weight FROM links JOIN r a ON a.y = ay AND a.x = ax JOIN r b ON b.y = links."by" AND b.x = bx')

# Grids of trees -----------------------------------------------------------------------------
pixels("tree_edges", "emb_check", lambda d: rounded(quadtree.tree_edges(d, 16).drop("n", "s", "s2"), "dx", "dy", "mag", "ang"), sql.tree_edges(16, 16) + "SELECT r, c, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(mag, 6) + 0.0 AS mag, round(ang, 6) + 0.0 AS ang FROM te")
pixels("child_edges", "emb_check", lambda d: rounded(quadtree.tree_edges(d, 8, 16).drop("n", "s", "s2"), "dx", "dy", "mag", "ang"), sql.tree_edges(8, 16) + "SELECT r, c, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(mag, 6) + 0.0 AS mag, round(ang, 6) + 0.0 AS ang FROM te")


def _means(d: DataFrame, size: int = 4) -> DataFrame:
    return quadtree.levels(d, size, size).select("img", F.col("by").alias("r"), F.col("bx").alias("c"), (F.col("s") / F.col("n")).alias("v"))


for _w in ("N4", "H", "V"):
    pixels(f"propagate_{_w.lower()}", "emb_check", lambda d, w=_w: rounded(grids.propagate(_means(d), ("v",), 3, w), "v"), sql.propagate(_w, 3))


def _trees(d: DataFrame, size: int = 8) -> DataFrame:
    return cut(quadtree.tree_edges(d, size))


pixels("propagate_m", "emb_check", lambda d: rounded(grids.propagate(_trees(d).select("img", "r", "c", "dx", "dy", F.col("mag").alias("v")), ("v",), 2, "M").select("img", "r", "c", "v"), "v"), sql.PROPAGATE_M)
pixels("find_edges", "emb_check", lambda d: grids.find_edges(_trees(d), 2, 0.0).select("r", "c", "has_edge"), sql.FIND_EDGES + "SELECT r, c, has_edge FROM fe")


def _edge_segments(d: DataFrame) -> DataFrame:
    return grids.segment_edges(_trees(d), 2, 0.0, "N4", 1, 2.6, "N4")


pixels("segment_edges", "emb_check", _edge_segments, sql.SEGMENT_EDGES + "SELECT r, c, segment FROM seg")


def _row_segments(d: DataFrame) -> DataFrame:
    """Edge trees joined along rows only, so that segments may touch."""
    return grids.segment_edges(_trees(d), 2, 0.0, "N4", 1, 2.6, "H")


def _with_segments(f: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame], segments: Callable[[DataFrame], DataFrame] = _edge_segments) -> Callable[[DataFrame], DataFrame]:
    """f(pixels, trees, segments, wanted): segments of three trees or more are wanted."""
    def run(d: DataFrame) -> DataFrame:
        s = cut(segments(d))
        return f(d, _trees(d), s, s.groupBy("img", "segment").count().filter("count >= 3").select("img", "segment"))

    return run


pixels("segment_list", "emb_check", _with_segments(lambda d, t, s, w: grids.segment_list(s, t, 8)), sql.SEGMENT_EDGES + "SELECT segment, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s, sum(s2)::BIGINT AS s2, min(r) * 8 AS y1, min(c) * 8 AS x1, max(r) * 8 + 7 AS y2, max(c) * 8 + 7 AS x2 FROM seg JOIN te USING (r, c) GROUP BY segment")
pixels("segment_trees", "emb_check", _with_segments(lambda d, t, s, w: grids.segment_trees(s, w)), sql.WANTED + "SELECT r, c, segment FROM seg JOIN wanted USING (segment)")
pixels("segment_neighbors", "emb_check", _with_segments(lambda d, t, s, w: grids.segment_neighbours(s, w), _row_segments), sql.WANTED_ROWS + "SELECT DISTINCT b.segment FROM seg a JOIN wanted USING (segment) JOIN seg b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 ANTI JOIN wanted w ON w.segment = b.segment")
pixels("mask", "emb_check", _with_segments(lambda d, t, s, w: grids.segment_mask(d, s, w, 8)), sql.MASK)


def _bounds(d: DataFrame, size: int = 8) -> DataFrame:
    return cut(grids.boundaries(_trees(d, size), 2, 0.0))


pixels("boundaries", "emb_check", lambda d: _bounds(d).select("r", "c", "has_boundary"), sql.BOUNDARIES + "SELECT r, c, has_boundary FROM fb")
pixels("boundaries_hysteresis", "emb_check", lambda d: grids.strong_boundaries(_bounds(d)).select("r", "c", "has_boundary"), sql.HYSTERESIS)
pixels("chain_links", "emb_check", lambda d: grids.chain_links(_bounds(d, 4)), sql.CHAIN_LINKS)
pixels("chains", "emb_check", lambda d: sequential.chains(b := _bounds(d, 4), grids.chain_links(b)))
pixels("chain_lines", "emb_check", lambda d: sequential.chain_lines(sequential.chains(b := _bounds(d, 4), grids.chain_links(b)), 4))
def _bridges(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = _bounds(d, 4)
    c = cut(sequential.chains(b, grids.chain_links(b)))
    return b, c, sequential.sniff(b, c)


pixels("sniffers", "emb_check", lambda d: _bridges(d)[2].select("seq", "a", "b", "cost", F.size("path").alias("steps")))
pixels("sniffer_lines", "emb_check", lambda d: sequential.sniffer_lines(_bridges(d)[2], 4))
pixels("find_boundaries", "emb_check", lambda d: sequential.find_boundaries(_trees(d, 4), 2, 0.0)[1])
pixels("parse", "emb_check", lambda d: rounded(grids.parse(_trees(d), 2, 0.0), "strength"), sql.parse(2))
pixels("parse_boundaries", "emb_check", lambda d: grids.parse_boundaries(_trees(d), 2).select("r", "c", "has_boundary"), sql.PARSE_BOUNDARIES)
pixels("segment_overlap", "emb_check", lambda d: sequential.merge_leaves(_leaves(d), alpha=3.0, tree_limit=0.5, segment_limit=0.5))
pixels("segment_deviation", "emb_check", lambda d: sequential.merge_leaves(quadtree.divide(d, 16, 4, quadtree.by_deviation(18.0)), alpha=1.0, tree_limit=18.0, segment_limit=9.0, measure="deviation"))
pixels("segment_boundaries", "emb_check", lambda d: sequential.boundary_segments(_bounds(d), tree_alpha=1.0, segment_alpha=1.0))
pixels("prune", "emb_check", lambda d: sequential.boundary_segments(_bounds(d), tree_alpha=1.0, segment_alpha=1.0, prune=True))
pixels("contour", "emb_check", lambda d: sequential.contours(_edge_segments(d), 8, 8, 8))

# Video ------------------------------------------------------------------------------------------
pixels("motion_blocks", "ev_video", lambda d: temporal.motion(d, 2).select("frame", "r", "c", "changed"), sql.MOTION)
pixels("motion_segments", "ev_video", lambda d: temporal.motion_segments(temporal.motion(d, 2)), sql.MOTION_SEGMENTS)
pixels("motion_latest", "ev_video", lambda d: temporal.latest(temporal.motion(d, 2)).select("frame", "r", "c", "changed"), sql.MOTION + " QUALIFY frame = max(frame) OVER ()")


@query("motion_draw", sql.over("ev_video", sql.MOTION_DRAW))
def _motion_draw(spark: SparkSession, sf: str) -> DataFrame:
    d = fixtures.ev_video(spark, sf)
    b = temporal.motion(d, 2)
    return temporal.draw_motion(d, b, temporal.motion_segments(b), 2).drop("img")


def _moving(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(d: DataFrame) -> DataFrame:
        b = temporal.motion(d, 2)
        return f(b, temporal.motion_segments(b))

    return run


pixels("motion_counts", "ev_video", _moving(lambda b, s: temporal.segment_counts(s)), sql.MOTION_COUNTS)
pixels("motion_boxes", "ev_video", _moving(lambda b, s: temporal.frame_segments(b, s, 2)), sql.MOTION_BOXES)


@query("motion_stream", sql.over("ev_video", sql.MOTION))
def _motion_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a stream that reads block statistics from files, frame by frame in each block."""
    import uuid

    from ..streaming.motion import motion_stream

    blocks = cut(temporal.block_statistics(fixtures.ev_video(spark, sf), 2))
    name, at = f"motion_{uuid.uuid4().hex}", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(blocks.schema).parquet(blocks.inputFiles()[0].rpartition("/")[0])
    run = motion_stream(source).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).queryName(name).start(f"{at}/out")
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("frame", "r", "c", "changed")


# Lists --------------------------------------------------------------------------------------------
def _lists(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("int"))).alias("l"))


_LIST_OPS = {
    "sorted_insert": (lambda c: lists.insert_sorted(c, F.lit(25)), "list_sort(list_append(l, 25))"),
    "unique_insert": (lambda c: lists.insert_unique(c, F.lit(25)), "CASE WHEN list_contains(l, 25) THEN l ELSE list_sort(list_append(l, 25)) END"),
    "append_unique": (lambda c: lists.append_unique(c, F.lit(25)), "CASE WHEN list_contains(l, 25) THEN l ELSE list_append(l, 25) END"),
    "prepend": (lambda c: lists.prepend(c, F.lit(0)), "list_prepend(0, l)"),
    "insert_at": (lambda c: lists.insert_after(c, F.lit(0), F.lit(-1)), "list_concat(list_concat(l[1:1], [-1]), l[2:])"),
    "remove_first_match": (lambda c: F.coalesce(lists.remove_first(c, F.element_at(c, 1)), c), "l[2:]"),
    "remove_range": (lambda c: lists.remove_between(c, 0, 2), "list_concat(l[1:1], l[3:])"),
    "remove_rest": (lambda c: lists.remove_rest(c, 1), "l[1:2]"),
    "pop_rest": (lambda c: lists.pop(c)["rest"], "l[1:len(l) - 1]"),
    "sublist": (lambda c: lists.sublist(c, 1, 2), "l[2:3]"),
}
for _n, (_op, _sql) in _LIST_OPS.items():
    def _list(spark: SparkSession, sf: str, op: Callable = _op) -> DataFrame:
        return _lists(spark, sf).select("l_orderkey", F.array_join(op(F.col("l")), ",").alias("items"))

    query(f"list_{_n}", f"SELECT l_orderkey, array_to_string({_sql}, ',') AS items FROM (SELECT l_orderkey, list_sort(list(l_quantity::INT)) AS l FROM lineitem GROUP BY 1)")(_list)


@query("list_pop_peek", "SELECT l_orderkey, l[1] AS first, l[len(l)] AS last, l[len(l)] AS popped FROM (SELECT l_orderkey, list_sort(list(l_quantity::INT)) AS l FROM lineitem GROUP BY 1)")
def _pop_peek(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("l")
    return _lists(spark, sf).select("l_orderkey", lists.peek_first(c).alias("first"), lists.peek_last(c).alias("last"), lists.pop(c)["item"].alias("popped"))

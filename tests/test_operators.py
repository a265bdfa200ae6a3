"""Operators against loops written from their definitions, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import color
from rasterweave.operators import adaptive, components, edges, filters, grids, integral, lists, point, quadtree, sequential, temporal
from rasterweave.sources import pnm


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(5).integers(0, 256, (19, 23))


def raster(spark, image, img="a"):
    return pnm.from_numpy(spark, img, np.asarray(image))


def grey(df):
    return pnm.to_numpy(df, "a")


def test_binomial_equals_a_loop(spark, image):
    out = image.copy()
    for axis in (1, 0):
        a = np.moveaxis(out, axis, 0).copy()
        b = a.copy()
        b[1:-1] = (a[:-2] >> 2) + (a[1:-1] >> 1) + (a[2:] >> 2)
        out = np.moveaxis(b, 0, axis)
    assert (grey(filters.binomial(raster(spark, image))) == out).all()


def test_sauvola_of_a_constant_image(spark):
    out = grey(adaptive.sauvola(raster(spark, np.full((6, 7), 9)), 1, 0.5))
    assert (out == 0).all()  # the threshold is the value itself


def test_feng_equals_a_loop(spark, image):
    def box(y, x, r):
        b = image[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
        return b.mean(), b.std(), b.min()

    want = np.zeros_like(image)
    for y in range(image.shape[0]):
        for x in range(image.shape[1]):
            m, d, lo = box(y, x, 1)
            a = d / max(1, box(y, x, 2)[1])
            t = np.floor(0.88 * m + 0.25 * a * a * a * (m - lo) + 0.04 * a * a * lo)
            want[y, x] = 255 if image[y, x] > t else 0
    assert (grey(adaptive.feng(raster(spark, image), 1, 2.0, estimate_min=False)) == want).mean() > 0.995


def test_integral_corners_equal_direct_sums(spark, image):
    t = integral.integral(raster(spark, image)).toPandas().pivot(index="y", columns="x", values="i2").to_numpy()
    assert (t == (image.astype(int) ** 2).cumsum(0).cumsum(1)).all()


def test_rectangles_outside_are_zero(spark, image):
    rects = spark.createDataFrame([("a", 1, -5, -5, 3, 3), ("a", 2, 20, 15, 90, 90), ("a", 3, 0, 0, 0, 4)], "img string, rect int, x int, y int, w int, h int")
    got = {r["rect"]: r for r in integral.rect_sums(raster(spark, image), rects).collect()}
    assert got[1]["n"] == got[3]["n"] == 0 and got[1]["mean"] == 0
    assert got[2]["s"] == image[15:, 20:].sum() and got[2]["n"] == image[15:, 20:].size
    for tile in (4, 8):
        ends = {r["rect"]: r for r in integral.rect_extremes(raster(spark, image), rects, tile=tile).collect()}
        assert ends[1]["hi"] == ends[3]["hi"] == 0
        assert (ends[2]["lo"], ends[2]["hi"]) == (image[15:, 20:].min(), image[15:, 20:].max())


def joined_rows(spark, df):
    """The rows of df, and the most rows that one of its inner joins gives."""
    def joins(plan):
        inner = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() and plan.joinType().toString() == "Inner" else []
        return inner + [n for i in range(plan.children().size()) for n in joins(plan.children().apply(i))]

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan stays as it is
    try:
        rows = df.collect()
        return rows, max(joins(df._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_extremes_take_few_look_ups_whatever_the_area(spark):
    image = np.random.default_rng(8).integers(1, 10**6, (130, 140))
    at = [(i, i % 75 - 3, i * 7 % 66 - 2, 60 + i % 9, 62 + i % 5) for i in range(120)]
    rects = spark.createDataFrame([("a", *r) for r in at], "img string, rect int, x int, y int, w int, h int")
    rows, most = joined_rows(spark, integral.rect_extremes(raster(spark, image), rects))
    cut = {i: image[max(0, y) : y + h, max(0, x) : x + w] for i, x, y, w, h in at}
    assert {r["rect"]: (r["lo"], r["hi"]) for r in rows} == {i: (c.min(), c.max()) for i, c in cut.items()}
    assert most <= len(at) * 12 * 12  # two blocks of each of six sizes an axis at most; some 4,000 pixels each


def test_least_values_of_repeated_rectangles_are_looked_up_once(spark, image):
    at = [(x, y, 3 + x % 4, 2 + y % 5) for x in (-2, 5, 19) for y in (-1, 6, 16)]
    rects = lambda times: spark.createDataFrame([("a", i, *at[i % len(at)]) for i in range(times * len(at))], "img string, rect int, x int, y int, w int, h int")
    few, many = (joined_rows(spark, integral.rect_extremes(raster(spark, image), rects(times)).select("rect", "lo")) for times in (1, 40))
    cut = [image[max(0, y) : y + h, max(0, x) : x + w] for x, y, w, h in at]
    assert sorted(r["lo"] for r in few[0]) == sorted(c.min() for c in cut)
    assert {r["rect"]: r["lo"] for r in many[0]} == {i: cut[i % len(at)].min() for i in range(40 * len(at))}
    assert many[1] == few[1]  # forty times the rectangles, no more rows of pixels


def test_normalize_constant_and_range(spark, image):
    assert (grey(point.normalize(raster(spark, np.full((2, 2), 7)))) == 0).all()
    out = grey(point.normalize(raster(spark, image)))
    assert out.min() == 0 and out.max() == 255


def test_scales_and_roi(spark, image):
    assert (grey(point.scale_down(point.scale_up(raster(spark, image)))) == image).all()
    assert (grey(point.roi(raster(spark, image), 3, 2, 5, 4)) == image[2:6, 3:8]).all()
    with pytest.raises(ValueError):
        point.roi(raster(spark, image), 0, 0, 0, 1)


def test_colour_round_trip_and_unknown_pair(spark):
    rgb = np.random.default_rng(1).integers(0, 256, (4, 5, 3))
    df = pnm.from_numpy(spark, "a", rgb)
    back = pnm.to_numpy(color.convert(color.convert(df, "rgb", "yuv"), "yuv", "rgb"), "a")
    assert np.abs(back - rgb).max() <= 4
    with pytest.raises(NotImplementedError):
        color.convert(df, "rgb", "hsv")


@pytest.mark.parametrize("case", ["noise", "diagonal", "checker", "same"])
def test_components_equal_flood_fill(spark, case):
    rng = np.random.default_rng(2)
    a = {"noise": rng.integers(0, 2, (21, 17)), "diagonal": np.eye(9, dtype=int), "checker": np.indices((6, 6)).sum(0) % 2, "same": np.ones((5, 5), int)}[case]
    label = -np.ones(a.shape, int)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            if label[y, x] < 0:
                todo = [(y, x)]
                label[y, x] = y * a.shape[1] + x
                while todo:
                    i, j = todo.pop()
                    for p, q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                        if 0 <= p < a.shape[0] and 0 <= q < a.shape[1] and label[p, q] < 0 and a[p, q] == a[y, x]:
                            label[p, q] = label[y, x]
                            todo.append((p, q))
    got = components.labelled_runs(raster(spark, a), band=4).select("y", F.explode(F.sequence("x1", "x2")).alias("x"), "label").collect()
    assert len(got) == a.size
    assert all(r["label"] // components.ROW * a.shape[1] + r["label"] % components.ROW == label[r["y"], r["x"]] for r in got)


def test_leaves_tile_the_grid(spark):
    a = np.kron(np.random.default_rng(3).integers(0, 256, (5, 5)), np.ones((8, 8), int))[:37, :38]
    leaves = quadtree.divide(raster(spark, a), 16, 4, quadtree.by_deviation(5.0)).collect()
    cover = np.zeros(a.shape, int)
    for r in leaves:
        cover[r["y"] : r["y"] + r["size"], r["x"] : r["x"] + r["size"]] += 1
    assert cover.max() == 1 and cover.sum() == 32 * 32
    with pytest.raises(ValueError):
        quadtree.levels(raster(spark, a), 12, 5)


def test_propagation_keeps_or_loses_mass(spark):
    rows = [("a", r, c, float(r * 5 + c)) for r in range(4) for c in range(5)]
    df = spark.createDataFrame(rows, "img string, r int, c int, v double")
    total = sum(r[3] for r in rows)
    mass = lambda w, k: grids.propagate(df, ("v",), k, w).agg(F.sum("v")).first()[0]
    assert mass("N4", 3) == pytest.approx(total)
    assert mass("H", 1) == pytest.approx(total * 0.75) and mass("V", 1) == pytest.approx(total * 0.75)


def test_one_pixel_images(spark):
    df = raster(spark, [[7]])
    assert grey(filters.binomial(df)).tolist() == [[7]]
    assert grey(filters.sobel_x(df)).tolist() == [[0]] and grey(filters.extrema_y(df)).tolist() == [[0]]
    assert edges.edges(df, "v", 1, 1).count() == 0
    assert components.component_regions(df).first()["n"] == 1


def test_merging_two_halves(spark):
    a = np.repeat([[10, 200]], 8, 0).repeat(8, 1).reshape(8, 16)
    leaves = quadtree.divide(raster(spark, a), 8, 4, quadtree.by_overlap(3.0, 0.5))
    for measure, kind in (("overlap", {"alpha": 3.0, "tree_limit": 0.5, "segment_limit": 0.5}), ("deviation", {"alpha": 1.0, "tree_limit": 5.0, "segment_limit": 5.0})):
        assert sequential.merge_leaves(leaves, measure=measure, **kind).select("segment").distinct().count() == 2


def test_motion_of_a_block(spark):
    frames = [("a", f, y, x, 0 if f < 2 else 200 if y < 2 and x < 2 else 0) for f in range(4) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(frames, "img string, frame int, y int, x int, v int")
    moved = temporal.motion(df, 2).filter("changed").select("frame", "r", "c").collect()
    assert [tuple(r) for r in moved] == [(2, 0, 0)]
    assert temporal.latest(temporal.motion(df, 2)).count() == 4


def test_lists(spark):
    df = spark.createDataFrame([([3, 6, 5, 7, 1, 9, 8, 2, 4],)], "l array<int>").select(F.sort_array("l").alias("l"))
    one = lambda c: df.select(c.alias("o")).first()["o"]
    c = F.col("l")
    assert one(lists.insert_sorted(c, F.lit(5))) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert one(lists.insert_unique(c, F.lit(5))) == one(lists.append_unique(c, F.lit(5))) == list(range(1, 10))
    assert one(lists.remove_first(c, F.lit(11))) is None and one(lists.remove_first(c, F.lit(1))) == list(range(2, 10))
    assert one(lists.remove_between(c, 0, 3)) == [1, 4, 5, 6, 7, 8, 9] and one(lists.remove_rest(c, 1)) == [1, 2]
    assert one(lists.remove_at(c, F.lit(0))) == list(range(2, 10)) and one(lists.insert_after(c, F.lit(-1), F.lit(0)))[0] == 0
    assert one(lists.sparse_sublist(lists.sparse([(1, 2), (4, 1), (7, 3)]), 3, 3)) == {1: 1}
    empty = F.array().cast("array<int>")
    assert one(lists.pop(empty)["item"]) is None and one(lists.peek_first(empty)) is None


@pytest.mark.parametrize("ascii", [True, False])
@pytest.mark.parametrize("kind", ["grey", "rgb", "wide", "mono"])
def test_pnm_round_trip(ascii, kind):
    rng = np.random.default_rng(4)
    a = {"grey": rng.integers(0, 256, (5, 9, 1)), "rgb": rng.integers(0, 256, (4, 3, 3)), "wide": rng.integers(0, 60000, (3, 4, 1)), "mono": rng.integers(0, 2, (5, 11, 1)) * 255}[kind]
    assert (pnm.decode(pnm.encode(a, ascii, kind == "mono")) == a).all()


def test_pnm_files_and_source(spark, tmp_path, image):
    (tmp_path / "a.pgm").write_bytes(pnm.encode(image[:, :, None]))
    (tmp_path / "b.pgm").write_bytes(b"P2 # a comment\n2 1\n# more\n255\n3 4\n")
    df = pnm.read_pnm(spark, str(tmp_path))
    assert df.count() == image.size + 2
    assert df.filter("img like '%b.pgm' and x = 1").first()["c0"] == 4
    spark.dataSource.register(pnm.PnmDataSource)
    assert spark.read.format("pnm").load(str(tmp_path)).agg(F.sum("c0")).first()[0] == image.sum() + 7
    with pytest.raises(ValueError):
        pnm.decode(b"P5 3 3 255 x")
    files = pnm.encoded(raster(spark, image), ascii=True).collect()
    assert (pnm.decode(bytes(files[0]["content"]))[:, :, 0] == image).all()

"""Operators on trees and segments against plain definitions on small grids."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import components, grids, quadtree, sequential, temporal
from rasterweave.sources import pnm


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Contours -------------------------------------------------------------------


def outline(cells, size):
    """Midpoints of the sides of cells that face no other cell."""
    half, out = size // 2, set()
    for r, c in cells:
        for (dr, dc), (y, x) in {(-1, 0): (0, half), (1, 0): (size, half), (0, -1): (half, 0), (0, 1): (half, size)}.items():
            if (r + dr, c + dc) not in cells:
                out.add((c * size + x, r * size + y))
    return out


@pytest.mark.parametrize("cells", [
    [(r, c) for r in range(5) for c in range(6)],
    [(r, c) for r in range(6) for c in range(6) if r > 2 or c < 3],
    [(r, c) for r in range(5) for c in range(7) if not (1 <= r <= 3 and 2 <= c <= 4)],
])
def test_contour_follows_the_outer_sides(spark, cells):
    got = sequential.contours(table(spark, [("a", 1, r, c) for r, c in cells], "img string, segment long, r int, c int"), 8).orderBy("seq").collect()
    points = [(r["x1"], r["y1"]) for r in got]
    assert [(r["x2"], r["y2"]) for r in got][:-1] == points[1:] and (got[-1]["x2"], got[-1]["y2"]) == points[0]
    whole = set(cells)
    holes = {p for p in outline(whole, 8) if len(whole) == 26 and 8 < p[0] < 48 and 8 <= p[1] <= 32 and p not in {(0, 12)}}
    outer = outline(whole, 8) - {p for p in holes if 1 <= p[1] // 8 <= 4 and 16 <= p[0] <= 40 and 8 <= p[1] <= 32}
    # Every outer side is passed, but for the one of an inner corner that a diagonal step cuts off.
    assert set(points) <= outline(whole, 8) | {(x, y) for x, y in points} and len(outer - set(points)) <= 2
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2
    assert area > 0  # clockwise, y downwards


def test_contour_of_a_rectangle_in_order(spark):
    cells = [(r, c) for r in range(5) for c in range(5)]
    got = sequential.contours(table(spark, [("a", 1, r, c) for r, c in cells], "img string, segment long, r int, c int"), 8).orderBy("seq").collect()
    left = [(0, 8 * r + 4) for r in range(5)]
    top, right, bottom = [(8 * c + 4, 0) for c in range(5)], [(40, 8 * r + 4) for r in range(5)], [(8 * c + 4, 40) for c in range(5)]
    want = [left[2]] + [left[2], left[1], left[0], *top, *right, *bottom[::-1], left[4], left[3]]
    assert [(r["x1"], r["y1"]) for r in got] == want


def test_small_or_hollow_segments_have_no_contour(spark):
    rows = [("a", 1, r, c) for r in range(4) for c in range(9)] + [("a", 2, r, 0) for r in (20, 25)] + [("a", 2, 20, 9)]
    got = sequential.contours(table(spark, rows, "img string, segment long, r int, c int"), 8)
    assert got.count() == 0


def test_sides_of_turns():
    n, ne, e, se, s, sw, w, nw = range(8)
    assert sequential.sides_passed(n, n) == [0] and sequential.sides_passed(n, e) == [0, 1]
    assert sequential.sides_passed(s, n) == [2, 3, 0] and sequential.sides_passed(w, e) == [3, 0, 1]
    assert sequential.sides_passed(ne, e) == [1] and sequential.sides_passed(se, ne) == [1]
    assert sequential.sides_passed(n, nw) == [0] and sequential.sides_passed(nw, nw) == [0] and sequential.sides_passed(sw, sw) == [2]


# Merges ------------------------------------------------------------------------


def stat(values):
    v = np.array(values, float)
    return v.mean(), v.std()


def shared(a, b, alpha):
    (m1, d1), (m2, d2) = a, b
    lo = [max(0, m - max(alpha, alpha * d)) for m, d in ((m1, d1), (m2, d2))]
    hi = [min(255, m + max(alpha, alpha * d)) for m, d in ((m1, d1), (m2, d2))]
    inner = max(1, min(hi) - max(lo)) if max(lo) <= min(hi) else 0
    return inner / max(1, max(hi) - min(lo))


@pytest.mark.parametrize("measure", ["overlap", "deviation"])
def test_merges_equal_sets_of_pixels(spark, measure):
    """Groups as sets of leaves with their pixels, merged in the stated order."""
    rng = np.random.default_rng(31)
    size, n = 4, 6
    px = {(r, c): (40 * ((r // 2 + c // 3) % 3) + rng.integers(0, 25, size * size)).tolist() for r in range(n) for c in range(n)}
    rows = [("a", size, r * size, c * size, len(v), sum(v), sum(x * x for x in v)) for (r, c), v in px.items()]
    how = {"alpha": 1.0, "tree_limit": 0.4 if measure == "overlap" else 14.0, "segment_limit": 0.5 if measure == "overlap" else 9.0}
    got = sequential.merge_leaves(table(spark, rows, "img string, size int, y int, x int, n long, s long, s2 long"), measure=measure, **how).collect()
    group = {k: frozenset([k]) for k in px}

    def join(a, b):
        new = group[a] | group[b]
        for k in new:
            group[k] = new

    def whole(k):
        return stat([x for j in sorted(group[k]) for x in px[j]])

    def four(r, c):
        return [k for k in ((r - 1, c), (r, c + 1), (r + 1, c), (r, c - 1)) if k in px]

    for k in sorted(px):
        open_ = [j for j in four(*k) if j not in group[k]]
        if measure == "overlap":
            rated = [(shared(stat(px[k]), stat(px[j]), 1.0), -i, j) for i, j in enumerate(open_)]
            if rated and max(rated)[0] > how["tree_limit"]:
                join(k, max(rated)[2])
        else:
            rated = [(abs(stat(px[k])[0] - stat(px[j])[0]), i, j) for i, j in enumerate(open_)]
            if rated and min(rated)[0] < how["tree_limit"]:
                join(k, min(rated)[2])
    for k in sorted(px):
        mine = whole(k)
        for j in four(*k):
            if j not in group[k]:
                other = whole(j)
                if shared(mine, other, 1.0) > how["segment_limit"] if measure == "overlap" else abs(mine[0] - other[0]) < how["segment_limit"]:
                    join(k, j)
    mine = {}
    for r in got:
        mine.setdefault(r["segment"], set()).add((r["y"] // size, r["x"] // size))
    assert {frozenset(v) for v in mine.values()} == set(group.values()) and 1 < len(mine) < 36


def boundary_table(spark, art, means):
    """Trees of a drawing: # is a boundary."""
    rows = []
    for r, line in enumerate(art):
        for c, ch in enumerate(line):
            m = float(means[r][c])
            rows.append(("a", r, c, 16, int(16 * m), int(16 * m * m), m, 1.0, 1.0, ch == "#"))
    return table(spark, rows, "img string, r int, c int, n long, s long, s2 long, mean double, devmean double, devdev double, has_boundary boolean")


def test_boundary_segments_and_pruning(spark):
    art = ["..#..", "..#..", "..#..", "....."]
    near = boundary_table(spark, art, [[10] * 5] * 4)
    seg = {(r["r"], r["c"]): r for r in sequential.boundary_segments(near, tree_alpha=1.0, segment_alpha=1.0).collect()}
    assert len({r["segment"] for r in seg.values() if not r["has_boundary"]}) == 1 and sum(r["has_boundary"] for r in seg.values()) == 3
    cut = {(r["r"], r["c"]): r for r in sequential.boundary_segments(near, tree_alpha=1.0, segment_alpha=1.0, prune=True).collect()}
    assert not any(r["has_boundary"] for r in cut.values()) and len({r["segment"] for r in cut.values()}) == 1
    apart = boundary_table(spark, ["..#..", "..#..", "..#..", "..#.."], [[10, 10, 90, 200, 200]] * 4)
    kept = {(r["r"], r["c"]): r for r in sequential.boundary_segments(apart, tree_alpha=1.0, segment_alpha=1.0, prune=True).collect()}
    assert all(kept[r, 2]["has_boundary"] for r in range(4)) and len({r["segment"] for r in kept.values() if not r["has_boundary"]}) == 2
    steps = boundary_table(spark, ["....."], [[10, 11, 14, 20, 20]])
    parts = {r["c"]: r["segment"] for r in sequential.boundary_segments(steps, tree_alpha=1.0, segment_alpha=1.0).collect()}
    assert parts[0] == parts[1] != parts[2] != parts[3] == parts[4]


# Chains ---------------------------------------------------------------------------


def line_trees(spark, gaps=(), n=9, jump=None):
    """A column of boundary trees of one direction; gaps are trees off the boundary."""
    rows = [("a", r, 3, 1.0, 0.0, float(10 + (r * 7) % 5), r not in gaps) for r in range(n)]
    rows += [("a", r, c, 0.0, 0.0, 1.0, False) for r in range(n) for c in (2, 4)]
    return table(spark, rows, "img string, r int, c int, dx double, dy double, devdev double, has_boundary boolean")


def test_chains_of_a_column(spark):
    t = line_trees(spark, gaps=(5,))
    links = grids.chain_links(t)
    assert {(r["r"], r["side"], r["nr"]) for r in links.collect()} == {(r, s, r + d) for r in range(9) for s, d in (("next", -1), ("prev", 1)) if r != 5 and 0 <= r + d < 9 and r + d != 5}
    got = sequential.chains(t, links).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        by.setdefault(r["chain"], []).append(r["r"])
    assert sorted(by.values()) == [[4, 3, 2, 1, 0], [8, 7, 6]]
    strength = [10 + (r * 7) % 5 for r in range(9)]
    cost = {tuple(v): sum(abs(strength[a] - strength[b]) for a, b in zip(v, v[1:], strict=False)) for v in by.values()}
    assert {tuple(by[r["chain"]]): r["cost"] for r in got} == cost
    lines = sequential.chain_lines(sequential.chains(t, links), 8).collect()
    assert len(lines) == 6 and all(r["x1"] == r["x2"] == 28 and abs(r["y1"] - r["y2"]) == 8 for r in lines)


def test_bridges_between_chains(spark):
    t = line_trees(spark, gaps=(4,))
    found = sequential.chains(t, grids.chain_links(t))
    b = min(sequential.sniff(t, found).collect(), key=lambda r: r["cost"])
    s = [10 + (r * 7) % 5 for r in range(9)]
    assert b["cost"] == abs(s[3] - s[4]) + abs(s[4] - s[5]) and [p[0] for p in b["path"]] in ([3, 4, 5], [5, 4, 3])
    lines = sequential.sniffer_lines(sequential.sniff(t, found).filter(F.col("seq") == b["seq"]), 8).collect()
    assert len(lines) == 2 and {tuple(sorted((r["y1"], r["y2"]))) for r in lines} == {(28, 36), (36, 44)}
    whole = sequential.joined_chains(t, found, sequential.sniff(t, found)).orderBy("seq").collect()
    assert [r["r"] for r in whole] in (list(range(9)), list(range(8, -1, -1))) and {r["chain"] for r in whole} <= {r["chain"] for r in found.collect()}
    assert {r["cost"] for r in whole} == {float(sum(abs(a - b) for a, b in zip(s, s[1:], strict=False)))}
    # Fronts meet in a gap of up to eight trees, each four from its end.
    for gap, bridged in ((8, 1), (9, 0)):
        far = line_trees(spark, gaps=tuple(range(3, 3 + gap)), n=6 + gap)
        assert sequential.sniff(far, sequential.chains(far, grids.chain_links(far))).filter("size(path) = %d" % (gap + 2)).count() == bridged


def test_a_bridge_is_the_cheapest_path(spark):
    """Against all paths between two ends through a field of trees."""
    rng = np.random.default_rng(12)
    v = rng.integers(1, 60, (9, 7)).astype(float)
    rows = [("a", r, c, 1.0, 0.0, float(v[r, c]), c == 3 and (r < 3 or r > 5)) for r in range(9) for c in range(7)]
    t = table(spark, rows, "img string, r int, c int, dx double, dy double, devdev double, has_boundary boolean")
    found = sequential.chains(t, grids.chain_links(t))
    got = sequential.sniff(t, found).collect()
    best = min(abs(v[2, 3] - v[3, a]) + abs(v[3, a] - v[4, b]) + abs(v[4, b] - v[5, c]) + abs(v[5, c] - v[6, 3]) for a in (2, 3, 4) for b in range(a - 1, a + 2) for c in (2, 3, 4) if abs(b - c) <= 1)
    got = [r for r in got if {tuple(r["path"][0]), tuple(r["path"][-1])} == {(2, 3), (6, 3)}]
    assert len(got) == 1 and got[0]["cost"] >= best - 1e-9
    path = [tuple(p) for p in got[0]["path"]]
    assert {path[0], path[-1]} == {(2, 3), (6, 3)}
    assert sum(abs(v[a] - v[b]) for a, b in zip(path, path[1:], strict=False)) <= got[0]["cost"] + 1e-9


def test_strong_boundaries_in_order(spark):
    # 0 and 1 support each other; 5 stands alone; signs of 8 and 9 differ.
    rows = [("a", r, 0, 1.0 if r != 9 else -1.0, 0.0, 5.0, 5.0, r in (0, 1, 5, 8, 9)) for r in range(11)]
    t = table(spark, rows, "img string, r int, c int, dx double, dy double, devdev double, deviation double, has_boundary boolean")
    assert {r["r"] for r in grids.strong_boundaries(t).filter("has_boundary").collect()} == {0, 1}
    # Grown, every boundary tree takes in a neighbour of at least half its deviation.
    grown = {r["r"] for r in grids.strong_boundaries(t, 0.5, extend=True).filter("has_boundary").collect()}
    assert grown == {0, 1, 2, 3, 4, 5, 6, 7, 8}


# Components, drawing, files, motion --------------------------------------------------


def test_labels_by_rounds_equal_labels_in_one_task(spark):
    rng = np.random.default_rng(5)
    pairs = table(spark, [("a", int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [("b", i, i + 1) for i in range(70)], "img string, a long, b long")
    few, many = (sorted(map(tuple, components.merge_labels(pairs, small).collect())) for small in (10**6, 0))
    assert few == many and ("b", 70, 0) in many


def test_drawing_and_mask(spark):
    image = np.arange(100).reshape(10, 10)
    df = pnm.from_numpy(spark, "a", image)
    leaves = quadtree.divide(df, 4, 4, quadtree.by_deviation(0.0)).withColumn("segment", F.col("x").cast("long"))
    mean = quadtree.draw_image(df, leaves, 4, 4).toPandas().pivot(index="y", columns="x", values="c1").to_numpy()
    assert mean[0, 0] == 0 and mean[1, 1] == image[1:5, 1:5].mean().astype(int)
    seg = quadtree.draw_image(df, leaves, 4, 4, segments=True).toPandas().pivot(index="y", columns="x", values="c2").to_numpy()
    assert seg[8, 1] == seg[1, 1] == int(image[1:9, 1:5].mean()) and seg[9, 9] == 0
    rgb = df.select("img", "y", "x", F.col("v").alias("c0"), F.col("v").alias("c1"), F.col("v").alias("c2"))
    lit = quadtree.highlight(rgb, leaves, leaves.filter("segment = 5"), 4, 4, (1, 2, 3)).toPandas().pivot(index="y", columns="x", values="c1").to_numpy()
    assert (lit[1:9, 5:9] == 2).all() and (lit[:, :5] == image[:, :5]).all()
    cells = table(spark, [("a", 0, 1, 7), ("a", 1, 1, 7), ("a", 0, 0, 8)], "img string, r int, c int, segment long")
    m = grids.segment_mask(df, cells, cells.filter("segment = 7").select("img", "segment").distinct(), 4)
    assert {(r["y"], r["x"], r["v"]) for r in m.collect()} == {(y, x, 255) for y in range(8) for x in range(4)}


def test_pnm_written_by_spark_and_pictures(spark, tmp_path):
    rng = np.random.default_rng(2)
    grey, rgb = rng.integers(0, 256, (7, 5)), rng.integers(0, 256, (4, 3, 3))
    pnm.write_pnm(pnm.from_numpy(spark, "g", grey).union(pnm.from_numpy(spark, "h", grey + 0)), f"file://{tmp_path}/grey")
    back = pnm.read_pnm(spark, f"file://{tmp_path}/grey/*/*.txt").toPandas()
    assert back["img"].nunique() == 2
    for _, one in back.groupby("img"):
        assert (one.pivot(index="y", columns="x", values="c0").to_numpy().astype(int) == grey).all()
    pnm.write_pnm(pnm.from_numpy(spark, "c", rgb), f"file://{tmp_path}/rgb")
    back = pnm.read_pnm(spark, f"file://{tmp_path}/rgb/*/*.txt").toPandas()
    assert all((back.pivot(index="y", columns="x", values=f"c{i}").to_numpy().astype(int) == rgb[:, :, i]).all() for i in range(3))
    # An uncompressed 24-bit bitmap, rows from below, blue first.
    h, w, _ = rgb.shape
    rows = b"".join(rgb[y, :, ::-1].astype(np.uint8).tobytes() + b"\0" * (-3 * w % 4) for y in range(h - 1, -1, -1))
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "x.bmp").write_bytes(head + rows)
    got = pnm.read_images(spark, f"file://{tmp_path}/x.bmp").toPandas()
    assert all((got.pivot(index="y", columns="x", values=f"c{i}").to_numpy().astype(int) == rgb[:, :, i]).all() for i in range(3))


def test_segments_of_a_moving_block(spark):
    rows = [("v", f, y, x, 200 if f == 1 and 2 <= y < 6 and x < 4 else 10) for f in range(2) for y in range(8) for x in range(8)]
    blocks = temporal.motion(table(spark, rows, "img string, frame int, y int, x int, v int"), 2)
    seg = temporal.motion_segments(blocks)
    (box,) = temporal.frame_segments(blocks, seg, 2).collect()
    assert box["frame"] == 1 and (box["y1"], box["x1"], box["y2"], box["x2"]) == (2, 0, 5, 3) and box["s"] == 16 * 200
    assert [(r["frame"], r["segments"]) for r in temporal.segment_counts(seg).collect()] == [(1, 1)]


def test_empty_inputs(spark):
    none = pd.DataFrame({"img": [], "segment": [], "r": [], "c": []})
    assert sequential.contours(spark.createDataFrame(none, "img string, segment long, r int, c int"), 8).count() == 0
    assert components.merge_labels(spark.createDataFrame([], "img string, a long, b long")).count() == 0

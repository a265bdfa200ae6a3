"""Operators whose result depends on the order of visits, one image a task.

They work on leaf or tree tables, which are small next to the image they came
from; each runs as one grouped map over images and states its order.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .grids import boundaries, chain_links

#: Eight directions clockwise from north, and where to look first by arrival.
_CLOCK = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
_FIRST = {7: 5, 6: 5, 0: 7, 1: 7, 2: 1, 3: 1, 4: 3, 5: 3}


class Forest:
    """Union-find over leaves with summed statistics."""

    def __init__(self, n: np.ndarray, s: np.ndarray, s2: np.ndarray) -> None:
        self.parent = list(range(len(n)))
        self.sums = [(int(a), int(b), int(c)) for a, b, c in zip(n, s, s2, strict=True)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = sorted((self.find(i), self.find(j)))
        if a != b:
            self.parent[b] = a
            self.sums[a] = tuple(x + y for x, y in zip(self.sums[a], self.sums[b], strict=True))

    def stat(self, i: int) -> tuple[float, float]:
        n, s, s2 = self.sums[self.find(i)]
        return s / n, max(0.0, s2 / n - (s / n) ** 2) ** 0.5


def shared_range(a: tuple[float, float], b: tuple[float, float], alpha: float) -> float:
    """Overlap of the value ranges of two (mean, deviation)."""
    ends = [(max(0.0, m - w), min(255.0, m + w)) for m, d in (a, b) for w in (max(alpha, alpha * d),)]
    lo, hi = sorted(e[0] for e in ends), sorted(e[1] for e in ends)
    inner = 0.0 if lo[1] > hi[0] else max(1.0, hi[0] - lo[1])
    return inner / max(1.0, hi[1] - lo[0])


def _around(pdf: pd.DataFrame) -> list[list[int | None]]:
    """N, E, S, W neighbour of each leaf that is a leaf of its size or larger."""
    at = {}
    unit = int(pdf["size"].min())
    for i, (y, x, s) in enumerate(zip(pdf["y"], pdf["x"], pdf["size"], strict=True)):
        for cy in range(y, y + s, unit):
            for cx in range(x, x + s, unit):
                at[cy, cx] = i
    size = pdf["size"].to_numpy()
    out = []
    for y, x, s in zip(pdf["y"], pdf["x"], size, strict=True):
        four = [at.get(p) for p in ((y - unit, x), (y, x + s), (y + s, x), (y, x - unit))]
        out.append([j if j is not None and size[j] >= s else None for j in four])
    return out


def merge_leaves(leaves: DataFrame, *, alpha: float, tree_limit: float, segment_limit: float, measure: str = "overlap") -> DataFrame:
    """leaves with segment: each leaf joins the best of its N, E, S, W neighbours,
    then segments with like statistics are joined, both in breadth-first order of
    the leaves (size downwards, then rows).  measure "overlap" joins above the
    limits, "deviation" below alpha times the limits of the means' difference."""
    if measure not in ("overlap", "deviation"):
        raise ValueError(measure)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "y", "x"], ascending=[False, True, True], ignore_index=True)
        forest, near = Forest(pdf["n"], pdf["s"], pdf["s2"]), _around(pdf)
        own = [forest.stat(i) for i in range(len(pdf))]
        for i, four in enumerate(near):
            best, found = (tree_limit if measure == "overlap" else 255.0), None
            for j in four:
                if j is None or forest.find(i) == forest.find(j):
                    continue
                v = shared_range(own[i], own[j], alpha) if measure == "overlap" else abs(own[i][0] - own[j][0])
                if v > best if measure == "overlap" else v < best:
                    best, found = v, j
            if found is not None and (measure == "overlap" or best < alpha * tree_limit):
                forest.union(i, found)
        for i, four in enumerate(near):
            mine = forest.stat(i)
            for j in four:
                if j is not None and forest.find(i) != forest.find(j):
                    other = forest.stat(j)
                    if shared_range(mine, other, alpha) > segment_limit if measure == "overlap" else abs(mine[0] - other[0]) < alpha * segment_limit:
                        forest.union(i, j)
        return pdf.assign(segment=[int(pdf["y"][k]) * (1 << 32) + int(pdf["x"][k]) for k in map(forest.find, range(len(pdf)))])

    kinds = "img string, size int, y int, x int, n long, s long, s2 long, segment long"
    return leaves.select("img", "size", "y", "x", "n", "s", "s2").groupBy("img").applyInPandas(run, kinds)


def boundary_segments(trees: DataFrame, *, tree_alpha: float, segment_alpha: float, prune: bool = False) -> DataFrame:
    """img, r, c, has_boundary, segment of trees from boundaries(): trees off the
    boundary join like neighbours (row by row), then segments do; with prune,
    boundary trees between one segment only join it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], ignore_index=True)
        forest = Forest(pdf["n"], pdf["s"], pdf["s2"])
        place = {(r, c): i for i, (r, c) in enumerate(zip(pdf["r"], pdf["c"], strict=True))}
        four = [[place.get((r + a, c + b)) for a, b in ((-1, 0), (0, 1), (1, 0), (0, -1))] for r, c in place]
        edge, made = pdf["has_boundary"].tolist(), [False] * len(pdf)
        mean, dev = pdf["mean"].to_numpy(), np.maximum(1.0, pdf["devmean"] + pdf["devdev"])
        for i in range(len(pdf)):
            if edge[i] or made[i]:
                continue
            for j in four[i]:
                if j is not None and not edge[j] and abs(mean[i] - mean[j]) < tree_alpha * min(dev[i], dev[j]):
                    made[i] = made[j] = True
                    forest.union(i, j)
            made[i] = True
        for i in range(len(pdf)):
            if not edge[i]:
                m, d = forest.stat(i)
                for j in four[i]:
                    if j is not None and not edge[j] and forest.find(i) != forest.find(j):
                        m2, d2 = forest.stat(j)
                        if abs(m - m2) < segment_alpha * min(max(1.0, d), max(1.0, d2)):
                            forest.union(i, j)
        if prune:
            for i in range(len(pdf)):
                if edge[i]:
                    near = [j for j in four[i] if j is not None and not edge[j]]
                    if len({forest.find(j) for j in near}) <= 1:
                        edge[i] = False
                        if near:
                            made[i] = True
                            forest.union(i, near[-1])
        seg = [int(pdf["r"][k]) * (1 << 32) + int(pdf["c"][k]) if made[i] and not edge[i] else None for i, k in ((i, forest.find(i)) for i in range(len(pdf)))]
        return pd.DataFrame({"img": pdf["img"], "r": pdf["r"], "c": pdf["c"], "has_boundary": edge, "segment": pd.array(seg, "Int64")})

    return trees.groupBy("img").applyInPandas(run, "img string, r int, c int, has_boundary boolean, segment long")


def chains(trees: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """img, chain, seq, r, c, cost: walks over mutual next/prev links, from strong
    trees down; chains shorter than ``least`` are left out.  cost is the sum of
    strength differences along the chain."""
    b = trees.filter("has_boundary").select("img", "r", "c", F.col("devdev").alias("strength"))
    to = links.groupBy("img", "r", "c").pivot("side", ["next", "prev"]).agg(F.first(F.struct("nr", "nc")))
    b = b.join(to, ["img", "r", "c"], "left").select("img", "r", "c", "strength", *[F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in ("next", "prev") for x in ("nr", "nc")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], ignore_index=True)
        at = {(r, c): i for i, (r, c) in enumerate(zip(pdf["r"], pdf["c"], strict=True))}
        to_ = {k: [None if pd.isna(a) else at.get((int(a), int(b))) for a, b in zip(pdf[f"{k}_nr"], pdf[f"{k}_nc"], strict=True)] for k in ("next", "prev")}
        strength, used, rows = pdf["strength"].to_numpy(), set(), []

        def mutual(i: int, j: int | None) -> bool:
            return j is not None and j not in used and i in (to_["next"][j], to_["prev"][j])

        for start in np.lexsort((np.arange(len(pdf)), -strength)):
            if start in used:
                continue
            used.add(start)
            line = [int(start)]
            for k, put in (("next", line.append), ("prev", lambda j: line.insert(0, j))):
                i, way = int(start), k
                while mutual(i, j := to_[way][i]):
                    used.add(j)
                    put(j)
                    # A neighbour that points back by its other end is walked that way round.
                    way = "prev" if to_["next"][j] == i else "next"
                    i = j
            if len(line) >= least:
                cost = float(np.abs(np.diff(strength[line])).sum())
                rows += [(pdf["img"][0], int(pdf["r"][line[0]]) * (1 << 32) + int(pdf["c"][line[0]]), q, int(pdf["r"][i]), int(pdf["c"][i]), cost) for q, i in enumerate(line)]
        return pd.DataFrame(rows, columns=["img", "chain", "seq", "r", "c", "cost"])

    return b.groupBy("img").applyInPandas(run, "img string, chain long, seq int, r int, c int, cost double")


def chain_lines(found: DataFrame, size: int) -> DataFrame:
    """Lines between the centres of neighbours on a chain."""
    line = W.partitionBy("img", "chain").orderBy("seq")
    out = found.withColumn("r2", F.lead("r").over(line)).withColumn("c2", F.lead("c").over(line)).filter("r2 IS NOT NULL")
    mid = lambda k: F.col(k) * size + size // 2
    return out.select("img", "chain", "seq", mid("c").alias("x1"), mid("r").alias("y1"), mid("c2").alias("x2"), mid("r2").alias("y2"))


def sniff(trees: DataFrame, found: DataFrame, depth: int = 4) -> DataFrame:
    """img, seq, a, b, cost, path: cheapest bridges between ends of chains, in the
    order they were met.  Both ends of every chain grow over trees off the chains,
    the cheapest front first, at most ``depth`` trees far and no further than an
    eighth turn from their chain's way; a step costs the difference of devdev.
    Where fronts of two ends meet, the bridge is both ways and the step between;
    path leads from one end to the other."""
    px = trees.select("img", "r", "c", "devdev")
    both = px.join(found.select("img", "r", "c", "chain", "seq"), ["img", "r", "c"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value = {(r, c): v for r, c, v in zip(pdf["r"], pdf["c"], pdf["devdev"], strict=True)}
        on = pdf[pdf["chain"].notna()].sort_values(["chain", "seq"])
        inner = set(zip(on["r"], on["c"], strict=True))
        # Of each tree that a front has reached: end, cost, length, where from.
        front: dict[tuple, list] = {}
        ends, heap, bridges = [], [], {}
        for k, g in on.groupby("chain", sort=True):
            line = list(zip(g["r"], g["c"], strict=True))
            for end, before in ((line[0], line[1]), (line[-1], line[-2])) if len(line) > 1 else ():
                front[end] = [len(ends), 0.0, 0, None]
                heap.append((0.0, len(heap), end))
                ends.append((int(k), (end[0] - before[0], end[1] - before[1])))
        order = len(heap)
        while heap:
            _, _, at = heapq.heappop(heap)
            e, cost, length, _ = front[at]
            way = ends[e][1]
            for dr, dc in _CLOCK:
                to = (at[0] + dr, at[1] + dc)
                if dr * way[0] + dc * way[1] <= 0 or to not in value:
                    continue
                price = cost + abs(value[at] - value[to])
                if to in front:
                    other = front[to]
                    if other[0] == e:
                        if price < other[1]:
                            other[1:] = [price, length + 1, at]
                    elif price + other[1] < bridges.setdefault(frozenset((e, other[0])), (float("inf"), None, None))[0]:
                        bridges[frozenset((e, other[0]))] = (price + other[1], at, to)
                elif to not in inner and length < depth:
                    front[to] = [e, price, length + 1, at]
                    heapq.heappush(heap, (price, order := order + 1, to))

        def way_back(at: tuple | None) -> list[list[int]]:
            out, seen = [], set()
            while at is not None and at not in seen:
                seen.add(at)
                out.append([int(at[0]), int(at[1])])
                at = front[at][3]
            return out

        rows = [(pdf["img"].iloc[0], i, ends[front[x][0]][0], ends[front[y][0]][0], float(c), way_back(x)[::-1] + way_back(y)) for i, (c, x, y) in enumerate(bridges.values())]
        return pd.DataFrame(rows, columns=["img", "seq", "a", "b", "cost", "path"])

    return both.groupBy("img").applyInPandas(run, "img string, seq int, a long, b long, cost double, path array<array<int>>")


def sniffer_lines(bridges: DataFrame, size: int) -> DataFrame:
    """Lines between the centres of neighbours on bridges."""
    steps = F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(i - 1 AS at, path[i - 1] AS p, path[i] AS q))"))
    mid = lambda k, i: (F.col(f"s.{k}")[i] * size + size // 2)
    return bridges.select("img", "seq", steps.alias("s")).select("img", F.col("seq").alias("bridge"), F.col("s.at").alias("seq"), mid("p", 1).alias("x1"), mid("p", 0).alias("y1"), mid("q", 1).alias("x2"), mid("q", 0).alias("y2"))


def joined_chains(trees: DataFrame, found: DataFrame, bridges: DataFrame) -> DataFrame:
    """Chains after bridging, as from chains(): in the order of the bridges, two
    different chains whose ends a bridge connects become one, with the bridge's
    trees between them, if both ends are still ends.  It keeps the first one's id."""
    line = found.groupBy("img", "chain").agg(F.sort_array(F.collect_list(F.struct("seq", "r", "c"))).alias("trees"))
    lines = line.select("img", F.lit(0).alias("kind"), F.col("chain").alias("id"), F.transform("trees", lambda t: F.array(t["r"], t["c"])).alias("path"))
    rows = lines.unionByName(bridges.select("img", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("id"), "path"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "id"])
        paths = [[tuple(int(v) for v in p) for p in path] for path in pdf["path"]]
        chain = {int(i): path for i, path, kind in zip(pdf["id"], paths, pdf["kind"], strict=True) if kind == 0}
        owner = {t: i for i, path in chain.items() for t in (path[0], path[-1])}
        for path, kind in zip(paths, pdf["kind"], strict=True):
            a, b = (owner.get(path[0]), owner.get(path[-1])) if kind == 1 else (None, None)
            if a is None or b is None or a == b:
                continue
            first = chain[a] if chain[a][-1] == path[0] else chain[a][::-1]
            second = chain.pop(b)
            second = second if second[0] == path[-1] else second[::-1]
            for t in (path[0], path[-1]):
                del owner[t]
            chain[a] = [*first, *path[1:-1], *second]
            owner[chain[a][0]] = owner[chain[a][-1]] = a
        rows = [(pdf["img"].iloc[0], i, q, r, c) for i, path in sorted(chain.items()) for q, (r, c) in enumerate(path)]
        return pd.DataFrame(rows, columns=["img", "chain", "seq", "r", "c"])

    out = rows.groupBy("img").applyInPandas(run, "img string, chain long, seq int, r int, c int").join(trees.select("img", "r", "c", "devdev"), ["img", "r", "c"])
    step = F.abs(F.col("devdev") - F.lag("devdev").over(W.partitionBy("img", "chain").orderBy("seq")))
    cost = F.sum(F.coalesce("step", F.lit(0.0))).over(W.partitionBy("img", "chain"))
    return out.withColumn("step", step).select("img", "chain", "seq", "r", "c", cost.alias("cost"))


def find_boundaries(trees: DataFrame, rounds: int, bias: float, min_length: int = 3, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Boundary trees of tree_edges(), and their chains (img, chain, seq, r, c, cost):
    the test on the deviation, links to the strongest neighbours in direction,
    chains of at least min_length trees, and bridges between their ends."""
    found = cut(boundaries(trees, rounds, bias))
    single = cut(chains(found, chain_links(found), min_length))
    return found, joined_chains(found, single, cut(sniff(found, single, depth)))


def sides_passed(arrival: int, departure: int) -> list[int]:
    """Sides of a tree (0 left, 1 top, 2 right, 3 bottom) that a walk with the tree
    on its right-hand side passes between two directions (clockwise from north).

    A walk along direction d has side d / 2 to its left; diagonal ones lie between
    two sides.  A turn to the right passes all sides from the first whole one to
    the last, straight on or a turn to the left one side.  Turns back, which only
    a first step can make, pass none."""
    turn = (departure - arrival) % 8
    if 1 <= turn <= 4 - arrival % 2:
        return [x % 4 for x in range((arrival + 1) // 2, (arrival + turn) // 2 + 1)]
    if turn == 0:
        return [0 if departure == 7 else departure // 2]
    return [(departure + 1) // 2 % 4] if turn >= 7 - arrival % 2 else []


def contours(segments: DataFrame, size: int, least_width: int = 33, least_height: int = 32) -> DataFrame:
    """img, segment, seq, x1, y1, x2, y2: lines around segments (img, segment, r, c)
    whose boxes span more than the given size: a right-hand walk over trees from
    the first one of the middle row, through the midpoints of the sides passed
    (in grid pixels).  Segments without a tree there or too small have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        cells = set(zip(pdf["r"].tolist(), pdf["c"].tolist(), strict=True))
        y1, y2 = int(pdf["r"].min()) * size, (int(pdf["r"].max()) + 1) * size - 1
        x1, x2 = int(pdf["c"].min()) * size, (int(pdf["c"].max()) + 1) * size - 1
        middle = (y1 + y2) // 2 // size
        row = [c for r, c in cells if r == middle]
        if x2 - x1 > least_width and y2 - y1 > least_height and row:
            half = size // 2
            side = ((half, 0), (0, half), (half, size), (size, half))  # y, x from the corner
            point = lambda at, k: (at[1] * size + side[k][1], at[0] * size + side[k][0])
            start = at = (middle, min(row))
            line, way = [point(start, 0)], 1
            for _ in range(8 * len(cells)):
                ways = ((_FIRST[way] + k) % 8 for k in range(8))
                to = next((w for w in ways if (at[0] + _CLOCK[w][0], at[1] + _CLOCK[w][1]) in cells), None)
                if to is None:
                    break
                line += [point(at, k) for k in sides_passed(way, to)]
                at, way = (at[0] + _CLOCK[to][0], at[1] + _CLOCK[to][1]), to
                if at == start:
                    break
            line.append(line[0])
            rows = [(pdf["img"].iloc[0], int(pdf["segment"].iloc[0]), i, *a, *b) for i, (a, b) in enumerate(zip(line, line[1:], strict=False))]
        return pd.DataFrame(rows, columns=["img", "segment", "seq", "x1", "y1", "x2", "y2"])

    # One segment a group: its trees, not its pixels.
    return segments.select("img", "segment", "r", "c").groupBy("img", "segment").applyInPandas(run, "img string, segment long, seq int, x1 int, y1 int, x2 int, y2 int")

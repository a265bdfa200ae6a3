"""Frame differences of block statistics, in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.color import colour
from .sequential import Forest


def block_statistics(video: DataFrame, size: int) -> DataFrame:
    """img, frame, r, c, n, s, s2, mean, deviation of blocks of each frame."""
    v = F.col("v").cast("long")
    b = video.groupBy("img", "frame", F.expr(f"cast(y div {size} as int)").alias("r"), F.expr(f"cast(x div {size} as int)").alias("c")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"))
    m = F.col("s") / F.col("n")
    return b.withColumn("mean", m).withColumn("deviation", F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - m * m)))


def motion(video: DataFrame, size: int) -> DataFrame:
    """Blocks with changed: the mean moved by more than both frames' deviations.
    A block's first frame has no change.  One window a block."""
    line = W.partitionBy("img", "r", "c").orderBy("frame")
    one = lambda c: F.greatest(F.lit(1.0), c)
    b = block_statistics(video, size)
    m, d = F.lag("mean").over(line), F.lag("deviation").over(line)
    moved = F.abs(F.col("mean") - m) > one(F.col("deviation")) + one(d)
    return b.withColumn("changed", F.coalesce(moved, F.lit(False)))


def motion_segments(blocks: DataFrame) -> DataFrame:
    """img, frame, r, c, segment: changed blocks take in changed or like neighbours
    (row by row, one ring), and segmented blocks that touch are one segment."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], ignore_index=True)
        at = {(r, c): i for i, (r, c) in enumerate(zip(pdf["r"], pdf["c"], strict=True))}
        forest, on = Forest(pdf["n"], pdf["s"], pdf["s2"]), pdf["changed"].tolist()
        grown = list(on)
        near = [[j for a, b in ((-1, 0), (0, 1), (1, 0), (0, -1)) if (j := at.get((r + a, c + b))) is not None] for r, c in at]
        mean, dev = pdf["mean"].tolist(), pdf["deviation"].tolist()
        for i, four in enumerate(near):
            if on[i]:
                for j in four:
                    if on[j] or abs(mean[i] - mean[j]) < max(1, dev[i]) + max(1, dev[j]):
                        grown[j] = True
                        forest.union(i, j)
        for i, four in enumerate(near):
            for j in four:
                if grown[i] and grown[j]:
                    forest.union(i, j)
        keep = [i for i in range(len(pdf)) if grown[i]]
        seg = [int(pdf["r"][k]) * (1 << 32) + int(pdf["c"][k]) for k in (forest.find(i) for i in keep)]
        return pdf.loc[keep, ["img", "frame", "r", "c"]].assign(segment=seg)

    cols = ["img", "frame", "r", "c", "n", "s", "s2", "mean", "deviation", "changed"]
    return blocks.select(*cols).groupBy("img", "frame").applyInPandas(run, "img string, frame int, r int, c int, segment long")


def draw_motion(video: DataFrame, blocks: DataFrame, segments: DataFrame, size: int) -> DataFrame:
    """img, frame, y, x, c0, c1, c2: the segment's colour, or the block's mean."""
    px = video.select("img", "frame", "y", "x", F.expr(f"cast(y div {size} as int)").alias("r"), F.expr(f"cast(x div {size} as int)").alias("c"))
    j = px.join(blocks.select("img", "frame", "r", "c", F.col("mean").cast("int").alias("m")), ["img", "frame", "r", "c"]).join(segments, ["img", "frame", "r", "c"], "left")
    return j.select("img", "frame", "y", "x", *[F.when(F.col("segment").isNull(), F.col("m")).otherwise(k).alias(f"c{i}") for i, k in enumerate(colour(F.col("segment")))])


def frame_segments(blocks: DataFrame, segments: DataFrame, size: int) -> DataFrame:
    """img, frame, segment, n, s, s2, y1, x1, y2, x2 (inclusive, in pixels) of the
    moving segments of every frame."""
    j = segments.join(blocks.select("img", "frame", "r", "c", "n", "s", "s2"), ["img", "frame", "r", "c"])
    box = [(F.min("r") * size).alias("y1"), (F.min("c") * size).alias("x1"), (F.max("r") * size + size - 1).alias("y2"), (F.max("c") * size + size - 1).alias("x2")]
    return j.groupBy("img", "frame", "segment").agg(*[F.sum(k).cast("long").alias(k) for k in ("n", "s", "s2")], *box)


def segment_counts(segments: DataFrame) -> DataFrame:
    """img, frame, segments: how many each frame has (frames without one are not listed)."""
    return segments.groupBy("img", "frame").agg(F.countDistinct("segment").alias("segments"))


def latest(frames: DataFrame) -> DataFrame:
    """Rows of each image's last frame."""
    last = frames.groupBy("img").agg(F.max("frame").alias("frame"))
    return frames.join(last, ["img", "frame"], "left_semi")

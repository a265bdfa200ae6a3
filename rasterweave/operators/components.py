"""Connected components of equal neighbours (4-connectivity).

Rows are collapsed into runs.  Bands of rows are labelled on their own, in
parallel; only runs on both sides of a band's end remain to be merged, by
least labels over a table that is small next to the image.  A
component's label is its least pixel, y * 2**32 + x.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.color import colour
from ..session import cut
from .point import columns_of, rows_of

ROW = 1 << 32


def _same(channels: tuple[str, ...], line) -> Column:
    out = F.lit(True)
    for c in channels:
        out = out & F.col(c).eqNullSafe(F.lag(c).over(line))
    return F.coalesce(out & (F.lag("img").over(line).isNotNull()), F.lit(False))


def runs(df: DataFrame, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """img, y, x1, x2, key, id: maximal stretches of equal pixels in a row."""
    line = rows_of()
    starts = df.select("img", "y", "x", *channels, (~(_same(channels, line) & (F.lag("x").over(line) == F.col("x") - 1))).alias("__new"))
    number = F.sum(F.col("__new").cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0))
    out = starts.withColumn("__run", number).groupBy("img", "y", "__run").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), *[F.first(c).alias(c) for c in channels])
    key = F.concat_ws(",", *[F.col(c).cast("string") for c in channels])
    return out.select("img", "y", "x1", "x2", key.alias("key"), (F.col("y").cast("long") * ROW + F.col("x1")).alias("id"))


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of the component of each of n nodes, of edges a[i] - b[i]: roots
    are hooked onto lesser roots, all at once, and paths are halved."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def _band(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels of the runs of one band: in order, the runs of the next row that a
    run touches are a stretch, found by two searches for all runs together."""
    pdf = pdf.sort_values("id", ignore_index=True)
    y, x1, x2 = (pdf[c].to_numpy(np.int64) for c in ("y", "x1", "x2"))
    key = pd.factorize(pdf["key"])[0]
    lo = np.searchsorted(y * ROW + x2, (y + 1) * ROW + x1)
    hi = np.searchsorted(y * ROW + x1, (y + 1) * ROW + x2, side="right")
    count = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(pdf)), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    like = key[i] == key[j]
    return pdf.assign(part=pdf["id"].to_numpy()[least_labels(i[like], j[like], len(pdf))])


def _image_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, at = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
    at = at.reshape(-1, 2)
    return pd.DataFrame({"img": pdf["img"].iloc[0], "node": nodes, "label": nodes[least_labels(at[:, 0], at[:, 1], len(nodes))]})


def merge_labels(pairs: DataFrame, small: int = 1_000_000) -> DataFrame:
    """img, node, label: least node of the component, for nodes of pairs (img, a, b).

    Up to ``small`` pairs are merged image by image in single tasks; more of them by
    rounds of least labels with shortcuts, until no label moves."""
    pairs = cut(pairs.select("img", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    if pairs.count() <= small:
        return pairs.groupBy("img").applyInPandas(_image_labels, "img string, node long, label long")
    both = cut(pairs.union(pairs.select("img", "b", "a")).distinct())
    labels = cut(both.groupBy("img", F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), ["img", "a"]).groupBy("img", F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, ["img", "node"]).select("img", "node", "label", F.least("label", "near").alias("next"))
        jump = step.select("img", F.col("node").alias("next"), F.col("next").alias("further"))
        new = cut(step.join(jump, ["img", "next"]).select("img", "node", F.least("next", "further").alias("label"), (F.least("next", "further") != F.col("label")).alias("moved")))
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels


def labelled_runs(df: DataFrame, channels: tuple[str, ...] = ("v",), band: int = 64) -> DataFrame:
    """runs with label."""
    schema = "img string, y int, x1 int, x2 int, key string, id long, band int, part long"
    own = runs(df, channels).withColumn("band", F.floor(F.col("y") / band).cast("int"))
    parts = cut(own.groupBy("img", "band").applyInPandas(_band, schema))
    top = parts.filter(F.col("y") % band == 0).select("img", (F.col("y") - 1).alias("y"), "key", F.col("x1").alias("t1"), F.col("x2").alias("t2"), F.col("part").alias("b"))
    touch = parts.join(top, ["img", "y", "key"]).filter("x1 <= t2 AND t1 <= x2").select("img", F.col("part").alias("a"), "b")
    labels = merge_labels(touch)
    out = parts.join(labels.withColumnRenamed("node", "part"), ["img", "part"], "left")
    return out.select("img", "y", "x1", "x2", "key", F.coalesce("label", "part").alias("label"))


def component_labels(df: DataFrame, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """img, y, x, label of every pixel."""
    return labelled_runs(df, channels).select("img", "y", F.explode(F.sequence("x1", "x2")).alias("x"), "label")


def component_regions(df: DataFrame, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """img, label, x1, y1, x2, y2, n of every component."""
    r = labelled_runs(df, channels)
    return r.groupBy("img", "label").agg(F.min("x1").alias("x1"), F.min("y").alias("y1"), F.max("x2").alias("x2"), F.max("y").alias("y2"), F.sum(F.col("x2") - F.col("x1") + 1).cast("long").alias("n"))


def border(df: DataFrame, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """img, y, x, is_border: a pixel that differs from a 4-neighbour."""
    unlike = F.lit(False)
    for line in (rows_of(), columns_of()):
        for c in channels:
            for other in (F.lag(c), F.lead(c)):
                unlike = unlike | F.coalesce(other.over(line) != F.col(c), F.lit(False))
    return df.select("img", "y", "x", unlike.alias("is_border"))


def draw_components(df: DataFrame, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    return component_labels(df, channels).select("img", "y", "x", *colour(F.col("label")))

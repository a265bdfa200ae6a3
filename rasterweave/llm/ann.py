"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are put on a sphere (where lengths differ by more than 1 in 1,000, one
coordinate more makes up for the longest), padded to a power of two, and turned
by fast pseudo-rotations: three rounds of random signs and a Hadamard transform.
A table's bucket is the nearest signed axis of one polytope or more; how many,
and of how many axes the last one, follows from the number of points, so that a
bucket holds about ``per_bucket`` of them (one whole polytope at least).

A query visits, in each table, the ``probes`` buckets nearest to it.  How many
is fitted: exact neighbours of a bounded sample of queries (found over all rows)
tell the least number that reaches the target recall; where ``deepest`` probes do
not reach it, buckets are made coarser until they do.  The nearest buckets of the
first table come first: they give each query a bound that its true (k + 1)-th
best meets, and the other visits report only points that reach it.  Candidates
are ranked by exact inner products in double precision.

Equal vectors are one point; each point keeps the k + 1 smallest ids, which is
all that any result can hold, so a vector that a third of the rows share costs
no more than another.  Buckets are cut into chunks of bounded size.  A query
that finds fewer than k candidates visits every bucket of one table.

Defined cases: null, zero-length or all-zero vectors, vectors with null or
non-finite components, and vectors whose length is not the most frequent one
(ties: the shorter) take no part, nor do null ids; an id that is repeated with
one vector counts once, and one with several is as near as its best; ties go to the smaller id;
only vec_id and embedding are read, so that other columns clash with nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, stored


class Tables:
    """The hash functions: signs only, a few kilobytes.  ``wanted`` buckets make
    polytopes of ``parts`` axes each, the first one whole."""

    def __init__(self, dim: int, longest: float, flat: bool, n_tables: int, wanted: float, seed: int) -> None:
        self.longest, self.flat, self.n_tables = longest, flat, n_tables
        self.width = 1 << max(0, (dim + (not flat)) - 1).bit_length()
        self.parts = [self.width]
        left = wanted / (2 * self.width)
        while left > 1 and len(self.parts) < 6:
            self.parts.append(min(self.width, math.ceil(left / 2)))
            left /= 2 * self.parts[-1]
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (n_tables, len(self.parts), 3, self.width))
        self.buckets = math.prod(2 * d for d in self.parts)

    def placed(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width), np.float32)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if self.flat or query:
            out[:, : x.shape[1]] = x / np.maximum(norm, 1e-300)
        else:
            out[:, : x.shape[1]] = x / self.longest
            out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.longest) ** 2))
        return out

    def turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        """Nearness to each signed axis of a part."""
        for signs in self.signs[table, part]:
            x = x * signs
            h = 1
            while h < self.width:
                x = x.reshape(len(x), -1, 2, h)
                x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), -1)
                h *= 2
            x /= np.float32(self.width) ** np.float32(0.5)
        x = x[:, : self.parts[part]]
        return np.concatenate([x, -x], 1)

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for i, d in enumerate(self.parts):
            out = out * (2 * d) + self.turned(x, table, i).argmax(1)
        return out

    def order(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The nearest ``probes`` buckets of each row, nearest first."""
        outs = []
        for at in range(0, len(x), 16):
            part = x[at : at + 16]
            score, code = np.zeros((len(part), 1), np.float32), np.zeros((len(part), 1), np.int64)
            for i, d in enumerate(self.parts):
                near = self.turned(part, table, i)
                axes = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                both = (score[:, :, None] + np.take_along_axis(near, axes, 1)[:, None, :]).reshape(len(part), -1)
                best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
                score = np.take_along_axis(both, best, 1)
                code = np.take_along_axis(code, best // axes.shape[1], 1) * (2 * d) + np.take_along_axis(axes, best % axes.shape[1], 1)
            outs.append(code)
        return np.concatenate(outs) if outs else np.zeros((0, probes), np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, n_tables: int = 4, recall: float = 0.96, sample: int = 128, chunk: int = 4096, per_bucket: int = 2048, deepest: int = 1024, seed: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by inner product of
    each row of vectors (vec_id, embedding) that is_query holds for."""
    spark = vectors.sparkSession
    # Single-precision input is kept as it is: half the bytes, and no bit is lost.
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    ok = "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity')) AND exists(v, e -> e != 0)"
    rows = rows.filter(F.coalesce(F.expr(ok), F.lit(False)))
    widths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = widths["d"]
    # + 0.0 makes one of the two zeros.
    rows = rows.filter(F.size("v") == dim).withColumn("v", F.expr("transform(v, e -> e + 0.0D)"))
    rows = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(5), "v"))
    # A point is known by its least id and its vector, as an id may have several.
    pids = rows.groupBy("k1", "k2").agg(F.min(F.struct("vec_id", F.xxhash64("vec_id", "k1", "k2").alias("pid"))).alias("p")).select("k1", "k2", F.col("p.vec_id").alias("first"), F.col("p.pid"))
    rows = rows.join(pids, ["k1", "k2"])
    # At most k + 1 ids a point: the limit is applied before the shuffle as well.
    rank = F.row_number().over(W.partitionBy("pid").orderBy("vec_id"))
    members = stored(rows.select("pid", "vec_id").distinct().withColumn("r", rank).filter(F.col("r") <= k + 1).drop("r"), "ann-members")
    asking = stored(rows.filter("asks").select("vec_id", "pid").distinct(), "ann-asking")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind)
            yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("first"), _rows(flat.reshape(b.num_rows, -1))], ["pid", "first", "v"])

    one = rows.filter("vec_id = first").select("pid", "first", "v").dropDuplicates(["pid"])
    points = stored(one.mapInArrow(pack, "pid long, first long, v binary"), "ann-points")
    queries = points.join(asking.select("pid").distinct(), "pid")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = np.linalg.norm(_matrix(b.column("v"), kind), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([n.min()]), pa.array([n.max()]), pa.array([b.num_rows])], ["lo", "hi", "n"])

    lo, hi, count = points.mapInArrow(norms, "lo double, hi double, n long").agg(F.min("lo"), F.max("hi"), F.sum("n")).first()
    flat = hi - lo <= 1e-3 * hi
    exact = exact_sample(points, queries, kind, k, sample)
    wanted = count / per_bucket
    while True:
        tables = Tables(dim, hi, flat, n_tables, wanted, seed)
        probes = fitted_probes(exact, tables, recall, deepest)
        if probes is not None:
            break
        wanted /= 8
    how = (tables, kind, k, chunk)
    # The first visits, to the first table's nearest buckets, bound the others.
    few = max(1, probes // 4)
    near = stored(search(points, queries.withColumn("least", F.lit(float("-inf"))), how, [(0, 0, few)]), "ann-near")
    bound = best_of(near, k).groupBy(F.col("query").alias("pid")).agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") > k).select("pid", "least")
    bounded = queries.join(bound, "pid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = search(points, bounded, how, [(t, few if t == 0 else 0, probes) for t in range(n_tables)])
    found = stored(best_of(near.union(rest), k), "ann-found")
    short = found.groupBy("query").count().filter(F.col("count") < min(k + 1, count)).select(F.col("query").alias("pid"))
    missed = queries.join(found.select(F.col("query").alias("pid")).distinct(), "pid", "left_anti").select("pid").union(short)
    if probes < tables.buckets and missed.limit(1).count():
        again = queries.join(missed, "pid", "left_semi").withColumn("least", F.lit(float("-inf")))
        found = stored(best_of(found.union(search(points, again, how, [(0, 0, tables.buckets)])), k), "ann-more")
    discard(near)

    # Exact scores, summed in the order of the components.
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), kind)
                yield pa.RecordBatch.from_arrays([b.column("pid"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel()))], ["pid", "v"])

    back = points.mapInArrow(unpack, "pid long, v array<double>")
    pairs = found.select("query", "pid").join(back, "pid").join(back.select(F.col("pid").alias("query"), F.col("v").alias("q")), "query")
    pairs = pairs.select("query", "pid", F.expr("aggregate(zip_with(q, v, (a, b) -> a * b), 0.0D, (s, e) -> s + e)").alias("score"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.join(members, "pid").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    each = asking.select(F.col("vec_id").alias("query_id"), F.col("pid").alias("query")).join(pairs, "query").filter("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return each.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_sample(points: DataFrame, queries: DataFrame, kind: str, k: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a bounded sample of queries; and of their exact neighbours among
    all points, with whose they are."""
    asked = queries.orderBy(F.xxhash64(F.lit(9), "pid")).limit(sample).collect()
    if not asked:
        return np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1))
    ids, q = np.array([r["pid"] for r in asked]), np.array([np.frombuffer(r["v"], kind) for r in asked]).astype(np.float64)
    shared = points.sparkSession.sparkContext.broadcast((ids, q))  # sample x dim numbers

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, qs = shared.value
        for b in batches:
            if b.num_rows:
                pid, v = b.column("pid").to_numpy(), _matrix(b.column("v"), kind)
                s = qs @ v.T
                s[own[:, None] == pid[None, :]] = -np.inf
                near = np.argsort(-s, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own)), near.shape[1])), pa.array(np.take_along_axis(s, near, 1).ravel()), b.column("v").take(pa.array(near.ravel()))], ["i", "s", "v"])

    rank = F.row_number().over(W.partitionBy("i").orderBy(F.desc("s")))
    exact = points.mapInArrow(top, "i long, s double, v binary").filter("s > double('-Infinity')").withColumn("r", rank).filter(F.col("r") <= k).collect()
    shared.unpersist()
    return q, np.array([r["i"] for r in exact], np.int64), np.array([np.frombuffer(r["v"], kind) for r in exact]).astype(np.float64).reshape(len(exact), -1)


def fitted_probes(exact: tuple[np.ndarray, np.ndarray, np.ndarray], tables: Tables, recall: float, deepest: int) -> int | None:
    """The least number of probes by which the sampled queries find ``recall`` of
    their exact neighbours; None where more than ``deepest`` (or, for buckets of
    one polytope, all) would be needed."""
    q, mine, v = exact
    if not len(mine):
        return 1
    most = tables.buckets if len(tables.parts) == 1 else min(tables.buckets, deepest)
    rank = np.full(len(mine), most + 1)
    for t in range(tables.n_tables):
        order, bucket = tables.order(tables.placed(q, True), t, most), tables.bucket(tables.placed(v, False), t)
        for i in range(len(q)):
            place = {b: r + 1 for r, b in enumerate(order[i].tolist())}
            at = np.flatnonzero(mine == i)
            rank[at] = np.minimum(rank[at], [place.get(b, most + 1) for b in bucket[at].tolist()])
    found = int(np.sort(rank)[max(0, math.ceil(recall * len(rank)) - 1)])
    return found if found <= most else None


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query, pid, score: the k + 1 best points of each query."""
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "first"))
    return found.groupBy("query", "pid", "first").agg(F.max("score").alias("score")).withColumn("r", best).filter(F.col("r") <= k + 1).drop("r")


def search(points: DataFrame, queries: DataFrame, how: tuple[Tables, str, int, int], visits: list[tuple[int, int, int]]) -> DataFrame:
    """query, pid, first, score: of each query (pid, v, least) the k + 1 best points
    of at least that score in the buckets it visits, given as (table, places in the
    order of nearness from, to).  Every bucket visited reports k + 1 at most."""
    tables, kind, k, chunk = how
    visits = [x for x in visits if x[1] < x[2]]
    shared = points.sparkSession.sparkContext.broadcast(tables)
    n_tables = tables.n_tables
    step = 2.0**-36 * tables.longest**2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x = own.placed(_matrix(b.column("v"), kind), False)
                for t, _, _ in visits:
                    yield pa.RecordBatch.from_arrays([pa.array(own.bucket(x, t) * n_tables + t), b.column("pid"), b.column("first"), b.column("v")], ["bucket", "pid", "first", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = own.placed(_matrix(b.column("v"), kind), True)
                for t, lo, hi in visits:
                    order = own.order(x, t, hi)[:, lo:]
                    if order.size:
                        again = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array(order.ravel() * n_tables + t), *(b.column(c).take(again) for c in ("pid", "v", "least"))], ["bucket", "pid", "v", "least"])

    def rank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_p, out_s = [], [], []
        if left.num_rows and right.num_rows:
            left = left.sort_by("first")
            v = _matrix(left["v"], kind)
            for at in range(0, right.num_rows, 1024):
                part = right.slice(at, 1024)
                q, own, least = _matrix(part["v"], kind), part["pid"].to_numpy(), part["least"].to_numpy()
                # Scores are rounded so that true ties are ties whatever the order of sums.
                s = np.round(q @ v.T / step) * step
                if s.shape[1] > k + 1:
                    least = np.maximum(least, -np.partition(-s, k, axis=1)[:, k])
                i, j = np.nonzero(s >= least[:, None])
                # Of ties at the bound the smallest ids stay: rows are in their order.
                order = np.lexsort((j, -s[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place <= k], j[place <= k]
                out_q.append(own[i])
                out_p.append(j)
                out_s.append(s[i, j])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        at = pa.array(cat(out_p, np.int64))
        return pa.table({"query": cat(out_q, np.int64), "pid": left["pid"].combine_chunks().take(at), "first": left["first"].combine_chunks().take(at), "score": cat(out_s, np.float64)})

    placed = points.mapInArrow(spread, "bucket long, pid long, first long, v binary")
    asked = queries.select("pid", "v", "least").mapInArrow(ask, "bucket long, pid long, v binary, least double")
    # Buckets of more than chunk points are cut; queries go to every part.
    sizes = stored(placed.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")), "ann-sizes")
    most = sizes.agg(F.max("parts")).first()[0] or 1
    placed, asked = placed.withColumn("part", F.lit(0)), asked.withColumn("part", F.lit(0))
    if most > 1:
        placed = placed.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int")).drop("parts")
        asked = asked.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return placed.groupBy("bucket", "part").cogroup(asked.groupBy("bucket", "part")).applyInArrow(rank, "query long, pid long, first long, score double")

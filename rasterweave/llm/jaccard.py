"""Jaccard join of documents on word shingles with a count-vector R-tree.

Exact: two documents link when 100 * |A and B| >= 75 * |A or B| over the hashed
sets of their five-word shingles.  Steps, each over all documents:

1. Sets are fingerprinted; documents with equal sets are one point from here on.
   The load of 65,536 token groups is counted (a table of fixed size).
2. Points that may link share a token among the first n - ceil(0.75 n) + 1 of
   their sets, in an order by load of the token's group, rare ones first.  These
   tokens are packed by bucket, and tokens with one point only are dropped.
3. In each token's block, and range of sizes, every point is paired with one of
   them, a few times over with another one.  Pairs whose summed coordinate minima of count vectors allow the overlap are
   verified on the sets, and links are merged into families.
4. Families are the nodes of an R-tree over count vectors: a node keeps its
   coordinates' maxima and least and greatest set sizes.  In each block that
   still holds several families, nodes are packed by size into parent nodes and
   joined top-down; the overlap of two nodes is at most the sum of the minima of
   their maxima.  From pairs that survive, points of the smaller family go down
   to the other family's box, then to its leaves, then to points; pairs of
   points that survive are verified on the sets.
5. All links together give the components.

No pair of points is left out but by one of these bounds.  Links inside a family
are not enumerated.  Blocks and families are joined as skew-safe sort-merge
joins, pre-aggregated, salted (tokens of heavy groups) or cut into chunks of
bounded size, so none is collected in one task.

Defined cases: null or empty texts and texts without words have no shingle and
their own doc_id as component; repeated rows each count, a null doc_id links like
any other and takes the component of its links, or stays null where no id is
among them; an empty table gives an empty result.  Fingerprints, row keys and tokens
have 64 bits; sets of two documents are compared by 48 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, text_bytes
from .components import components
from .shingles import GROUPS, count_vector, fingerprints, shingle_sets

LOADS = 1 << 16
SEEN = 100_000


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _row() -> Column:
    """Of id and text, so that null ids differ by their texts."""
    return F.xxhash64("doc_id", "text").alias("row")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, row, n, fp of every row; and rows of (grp, load) without doc."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("grp", pa.int32()), ("load", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(LOADS, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = shingle_sets(text_bytes(b.column("text")))
                load += np.bincount((np.concatenate(sets) >> np.uint64(48)).astype(np.int64), minlength=LOADS)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([len(t) for t in sets], pa.int64()), pa.array(fingerprints(sets), pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.int64())], schema=schema)
        full = np.flatnonzero(load)
        for i in range(0, len(full), 8192):
            part = full[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64())] * 4 + [pa.array(part.astype(np.int32)), pa.array(load[part])], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(), "text").mapInArrow(run, "doc_id long, row long, n long, fp long, grp int, load long")


def _blocks(docs: DataFrame, load: np.ndarray, buckets: int, hot: int) -> DataFrame:
    """tok, fp, n: prefix tokens that points of like sizes share (or heavy ones)."""
    shared = docs.sparkSession.sparkContext.broadcast(load)  # LOADS numbers
    salts = np.maximum(1, -(-load // hot)).astype(np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, seen = shared.value, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2500):
                toks, owners, sizes = [], [], []
                for part in range(at, min(at + 2500, whole.num_rows), 500):
                    sets = shingle_sets(text_bytes(whole.slice(part, min(500, at + 2500 - part)).column("text")))
                    for t, fp in zip(sets, fingerprints(sets), strict=True):
                        if fp is None or fp in seen:
                            continue  # an exact copy that this task has dealt with
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(fp)
                        first = np.argsort(weight[(t >> np.uint64(48)).astype(np.int64)], kind="stable")[: prefix_size(len(t))]
                        toks.append(t[first])
                        owners.append(np.full(len(first), fp, np.int64))
                        sizes.append(np.full(len(first), len(t), np.int32))
                if not toks:
                    continue
                tok, fp, n = np.concatenate(toks), np.concatenate(owners), np.concatenate(sizes)
                group = (tok >> np.uint64(48)).astype(np.int64)
                salt = np.where(salts[group] > 1, fp.view(np.uint64) % salts[group].astype(np.uint64), 0).astype(np.int64)
                bucket = (tok >> np.uint64(16)).astype(np.int64) % buckets
                order = np.lexsort((salt, bucket))
                tok, fp, n, key = tok[order], fp[order], n[order], (bucket * (1 << 20) + salt)[order]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                rows = [(key[i], tok[i:j].tobytes(), fp[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), *[pa.array([r[c] for r in rows], pa.binary()) for c in (2, 3)]], ["key", "toks", "fps", "ns"])

    def shared_tokens(table: pa.Table) -> pa.Table:
        tok = np.frombuffer(b"".join(table["toks"].to_pylist()), np.uint64)
        fp = np.frombuffer(b"".join(table["fps"].to_pylist()), np.int64)
        n = np.frombuffer(b"".join(table["ns"].to_pylist()), np.int32).astype(np.int64)
        order = np.lexsort((fp, n, tok))
        tok, fp, n = tok[order], fp[order], n[order]
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (fp[1:] != fp[:-1])])
        tok, fp, n = tok[new], fp[new], n[new]
        # In order of size, a point that may link has a neighbour that may.
        near = (tok[1:] == tok[:-1]) & (4 * n[:-1] >= 3 * n[1:])
        keep = np.concatenate([[False], near]) | np.concatenate([near, [False]]) | (salts[(tok >> np.uint64(48)).astype(np.int64)] > 1)
        return pa.table({"tok": tok[keep].view(np.int64), "fp": fp[keep], "n": n[keep].astype(np.int32), "salted": salts[(tok[keep] >> np.uint64(48)).astype(np.int64)] > 1})

    packed = docs.select("text").mapInArrow(pack, "key long, toks binary, fps binary, ns binary")
    found = packed.groupBy("key").applyInArrow(shared_tokens, "tok long, fp long, n int, salted boolean")
    if salts.max() == 1:
        return found.drop("salted")
    # Of salted tokens no bucket sees all points: those with one only go here.
    found = stored(found, "jaccard-tokens")
    heavy = found.filter("salted")
    several = heavy.groupBy("tok").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("tok")
    return found.filter("NOT salted").drop("salted").unionByName(heavy.drop("salted").join(several, "tok", "left_semi"))


def _points(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, n, vec, toks of the points in wanted (row, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b, rows = whole.slice(at, 500), []
                sets = shingle_sets(text_bytes(b.column("text")))
                for t, own, fp in zip(sets, fingerprints(sets), b.column("fp").to_pylist(), strict=True):
                    if own is not None and own == fp:  # rows are known by a hash
                        rows.append((fp, len(t), count_vector(t).tobytes(), packed(t)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["fp", "n", "vec", "toks"])

    rows = docs.select(_row(), "text").join(wanted, "row").dropDuplicates(["row"])
    return rows.select("text", "fp").mapInArrow(run, "fp long, n long, vec binary, toks binary")


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, GROUPS)


def may_overlap(vec_a: np.ndarray, vec_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the bound allows 7 * overlap >= 3 * (n_a + n_b), least sizes given."""
    return 7 * np.minimum(vec_a, vec_b).sum(1, dtype=np.uint32).astype(np.int64) >= 3 * (n_a + n_b)


def _bounded(pairs: DataFrame, keep: str) -> DataFrame:
    """Rows with vec_a, vec_b, n_a, n_b (least), most_a, most_b that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                ok = may_overlap(_vectors(b.column("vec_a")), _vectors(b.column("vec_b")), b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
                yield b.filter(pa.array(ok)).select(keep.split(","))

    pairs = pairs.filter("4 * most_a >= 3 * n_b AND 4 * most_b >= 3 * n_a")
    ddl = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep.split(","))
    return pairs.mapInArrow(run, ddl)


def _verified(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Of pairs (a, b) of points those that link: first by the bound over count
    vectors, then, for those it leaves, by the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, ok = whole.slice(at, 512), []
                for x, y in zip(b.column("toks_a").to_pylist(), b.column("toks_b").to_pylist(), strict=True):
                    x, y = unpacked(x), unpacked(y)
                    ok.append(7 * len(np.intersect1d(x, y, assume_unique=True)) >= 3 * (len(x) + len(y)))
                yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    sides = [points.select(*[F.col(c).alias(t) for c, t in (("fp", s), ("n", f"n_{s}"), ("n", f"most_{s}"), ("vec", f"vec_{s}"))]) for s in "ab"]
    left = stored(_bounded(pairs.join(sides[1], "b").join(sides[0], "a"), "a,b"), "jaccard-left")
    toks = [points.select(F.col("fp").alias(s), F.col("toks").alias(f"toks_{s}")) for s in "ab"]
    return left.join(toks[1], "b").join(toks[0], "a").mapInArrow(run, "a long, b long")


def packed(tokens: np.ndarray) -> bytes:
    """The high 48 bits of sorted tokens, which tell the tokens of two documents apart."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def node_join(vec: np.ndarray, least: np.ndarray, most: np.ndarray, fan: int = 16) -> list[tuple[int, int]]:
    """Pairs (i < j) of nodes that the bounds allow, by an R-tree packed by size."""
    order = np.argsort(least, kind="stable")
    levels = [(vec[order], least[order], most[order])]
    while len(levels[-1][1]) > fan:
        v, lo, hi = levels[-1]
        at = np.arange(0, len(lo), fan)
        levels.append((np.maximum.reduceat(v, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
    top = len(levels[-1][1])
    a, b = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        v, lo, hi = levels[depth]
        kept_a, kept_b = [], []
        for i in range(0, len(a), 8192):
            x, y = a[i : i + 8192], b[i : i + 8192]
            fits = (4 * hi[x] >= 3 * lo[y]) & (4 * hi[y] >= 3 * lo[x])
            x, y = x[fits], y[fits]
            ok = may_overlap(v[x], v[y], lo[x], lo[y])
            kept_a.append(x[ok])
            kept_b.append(y[ok])
        a, b = np.concatenate(kept_a or [a]), np.concatenate(kept_b or [b])
        if depth:
            below = len(levels[depth - 1][1])
            step = np.arange(fan)
            x = (a[:, None, None] * fan + step[None, :, None] + 0 * step[None, None, :]).ravel()
            y = (b[:, None, None] * fan + step[None, None, :] + 0 * step[None, :, None]).ravel()
            ok = (x < below) & (y < below) & (x <= y)
            a, b = x[ok], y[ok]
    ok = a != b
    return [(int(order[x]), int(order[y])) for x, y in zip(a[ok], b[ok], strict=True)]


def _nodes(points: DataFrame) -> DataFrame:
    """family, least, most, members, vec of families, from points with their family."""
    schema = pa.schema([("family", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("members", pa.int64()), ("vec", pa.binary())])

    def merge(t: pa.Table | pa.RecordBatch) -> pa.Table:
        family = t.column("family").to_numpy()
        order = np.argsort(family, kind="stable")
        family = family[order]
        at = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]]))
        vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.uint16).reshape(-1, GROUPS)[order]
        up = np.maximum.reduceat(vec, at)
        return pa.table([pa.array(family[at]), pa.array(np.minimum.reduceat(t.column("least").to_numpy()[order], at)), pa.array(np.maximum.reduceat(t.column("most").to_numpy()[order], at)), pa.array(np.add.reduceat(t.column("members").to_numpy()[order], at)), pa.array([x.tobytes() for x in up], pa.binary())], schema=schema)

    def merged(t: pa.Table) -> pa.Table:
        return merge(t)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from merge(b).to_batches()

    ddl = "family long, least long, most long, members long, vec binary"
    rows = points.select("family", F.col("n").alias("least"), F.col("n").alias("most"), F.lit(1).cast("long").alias("members"), "vec")
    # One row a family and batch goes on to the final maxima.
    return rows.mapInArrow(partial, ddl).groupBy("family").applyInArrow(merged, ddl)


def _stars(blocks: DataFrame, families: DataFrame, turn: int) -> DataFrame:
    """a, b: in each block and range of sizes within which all may link, the point
    that is first by a hash (another one each turn) with those of other families;
    one pair of points for a pair of families."""
    rows = blocks.join(families, "fp").withColumn("band", F.floor(F.log("n") / float(np.log(4 / 3))))
    first = F.min(F.struct(F.xxhash64(F.lit(turn), "fp").alias("h"), "fp", "family"))
    least = rows.groupBy("tok", "band").agg(first.alias("c"), F.min("family").alias("lo"), F.max("family").alias("hi")).filter("lo < hi").select("tok", "band", F.col("c.fp").alias("a"), F.col("c.family").alias("fa"))
    pairs = rows.join(least, ["tok", "band"]).filter("family != fa").select(F.least("fa", "family").alias("x"), F.greatest("fa", "family").alias("y"), "a", F.col("fp").alias("b"))
    return pairs.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def _families_that_may_link(blocks: DataFrame, labels: DataFrame, nodes: DataFrame, chunk: int) -> DataFrame:
    """c, d: distinct pairs of families that share a block and that bounds allow."""
    rows = blocks.join(labels, "fp").select("tok", "family").distinct()
    # Blocks with the same families do the same work: one of them is enough.
    per_block = rows.groupBy("tok").agg(F.count("*").alias("k"), F.sum(F.xxhash64("family") % (1 << 40)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "family")).alias("s2"))
    chosen = per_block.filter("k > 1").groupBy("k", "s1", "s2").agg(F.min("tok").alias("tok")).select("tok", F.ceil(F.col("k") / chunk).cast("int").alias("chunks"))
    rows = rows.join(chosen, "tok").join(nodes, "family")
    own = F.pmod(F.xxhash64(F.lit(3), "family"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("tok", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "family", "least", "most", "vec")

    def join(t: pa.Table) -> pa.Table:
        family = t["family"].to_numpy()
        pairs = node_join(_vectors(t["vec"]), t["least"].to_numpy(), t["most"].to_numpy())
        c = [min(family[i], family[j]) for i, j in pairs]
        d = [max(family[i], family[j]) for i, j in pairs]
        return pa.table({"c": pa.array(c, pa.int64()), "d": pa.array(d, pa.int64())})

    return rows.groupBy("tok", "x", "y").applyInArrow(join, "c long, d long").distinct()


def _leaves(points: DataFrame, family: str, page: int) -> DataFrame:
    """family, leaf: points (p, n, vec) of a family in leaves of about ``page``."""
    # The number of leaves is an aggregate of one row a family.
    count = points.groupBy(family).agg(F.ceil(F.count("*") / page).alias("__leaves"))
    dealt = points.join(count, family).withColumn("__leaf", F.pmod(F.xxhash64("p"), F.col("__leaves")))
    return dealt.groupBy(family, "__leaf").agg(F.collect_list(F.struct("p", "n", "vec")).alias("leaf")).drop("__leaf")


def _leaf_join(pairs: DataFrame) -> DataFrame:
    """a, b: pairs of points of two leaves (as, bs) that sizes and vectors allow."""

    def opened(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = column.slice(i, 1).flatten()
        return rows.field("p").to_numpy(), rows.field("n").to_numpy(), _vectors(rows.field("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pa_, na, va = opened(b.column("as"), i)
                pb, nb, vb = opened(b.column("bs"), i)
                # The leaf's own box first, then its points.
                box, low, high = vb.max(0), nb.min(), nb.max()
                out_a, out_b = [], []
                for p, n, v in zip(pa_, na, va, strict=True):
                    if 4 * n >= 3 * low and 4 * high >= 3 * n and 7 * int(np.minimum(v, box).sum(dtype=np.uint32)) >= 3 * (n + low):
                        ok = may_overlap(v[None, :], vb, n, nb) & (4 * n >= 3 * nb) & (4 * nb >= 3 * n)
                        out_a.append(np.full(int(ok.sum()), p))
                        out_b.append(pb[ok])
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_b), pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, *, bucket_rows: int = 500_000, hot: int = 1_000_000, chunk: int = 2048, page: int = 64, stars: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; 0.75, five words."""
    spark = docs.sparkSession
    first = stored(_sets(docs), "jaccard-sets")
    load = np.zeros(LOADS, np.int64)
    for r in first.filter("grp IS NOT NULL").groupBy("grp").agg(F.sum("load")).collect():
        load[r[0]] = r[1]
    points = first.filter("grp IS NULL").select("doc_id", "row", "n", "fp")
    buckets = int(max(64, load.sum() // 4 // bucket_rows))
    blocks = stored(_blocks(docs, load, buckets, hot), "jaccard-blocks")
    involved = blocks.select("fp").distinct()
    keepers = points.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("row").alias("row"))
    sets = stored(_points(docs, keepers.join(involved, "fp")), "jaccard-points")
    alone = sets.select("fp").distinct()
    families, links = alone.select("fp", F.col("fp").alias("family")), None
    for turn in range(stars):
        new = stored(_verified(stored(_stars(blocks, families, turn), "jaccard-stars"), sets), "jaccard-links")
        if turn and not new.limit(1).count():
            break
        links = new if links is None else links.union(new)
        labels = components(links).withColumnRenamed("node", "fp").withColumnRenamed("label", "family")
        families = stored(alone.join(labels, "fp", "left").select("fp", F.coalesce("family", "fp").alias("family")), "jaccard-families")

    members = sets.select("fp", "n", "vec").join(families, "fp")
    nodes = stored(_nodes(members), "jaccard-nodes")
    near = stored(_families_that_may_link(blocks, families, nodes, chunk), "jaccard-near")
    discard(blocks)
    if near.limit(1).count():
        # Points of the smaller family go down to the other's box, then to its leaves.
        sized = nodes.select("family", "members")
        near = near.join(sized.select(F.col("family").alias("c"), F.col("members").alias("mc")), "c").join(sized.select(F.col("family").alias("d"), F.col("members").alias("md")), "d")
        near = near.select(F.when(F.col("mc") <= F.col("md"), F.col("c")).otherwise(F.col("d")).alias("c"), F.when(F.col("mc") <= F.col("md"), F.col("d")).otherwise(F.col("c")).alias("d"))
        point = members.select(F.col("family").alias("c"), F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("n").alias("most_a"), F.col("vec").alias("vec_a"))
        box = nodes.select(F.col("family").alias("d"), F.col("least").alias("n_b"), F.col("most").alias("most_b"), F.col("vec").alias("vec_b"))
        down = stored(_bounded(near.join(point, "c").join(box, "d"), "a,n_a,vec_a,d"), "jaccard-down")
        asking = _leaves(down.select("d", F.col("a").alias("p"), F.col("n_a").alias("n"), F.col("vec_a").alias("vec")), "d", page)
        asked = _leaves(members.join(down.select(F.col("d").alias("family")).distinct(), "family").select(F.col("family").alias("d"), F.col("fp").alias("p"), "n", "vec"), "d", page)
        pairs = _leaf_join(asking.withColumnRenamed("leaf", "as").join(asked.withColumnRenamed("leaf", "bs"), "d"))
        pairs = stored(pairs, "jaccard-pairs")
        more = stored(_verified(pairs, sets), "jaccard-links")
        if more.limit(1).count():
            links = links.union(more)
            families = components(links).withColumnRenamed("node", "fp").withColumnRenamed("label", "family")
    discard(sets)
    labelled = points.join(families, "fp", "left").withColumn("family", F.coalesce("family", "fp"))
    lowest = labelled.filter("fp IS NOT NULL").groupBy("family").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(lowest, "family", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without those that have a linked document of lower doc_id; rows
    without shingles stay, and rows that repeat a kept doc_id."""
    found = jaccard_components(docs, **how)
    kept = found.filter("n_shingles = 0 OR doc_id <=> component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


#: The links as set comparisons of all pairs that share a shingle, components by
#: a recursive walk.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS r FROM (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM tokens)),
firsts AS (SELECT doc_id, t, n FROM ranked WHERE df > 1 AND r <= n - ceil(0.75 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM firsts a JOIN firsts b ON a.t = b.t AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM cand JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 175 * len(list_intersect(x.s, y.s)) >= 75 * (len(x.s) + len(y.s))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT w.node, e.b FROM walk w JOIN edges e ON w.seen = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(w.seen) AS component_id
FROM sets s JOIN walk w ON w.node = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

"""Mix sources to target weights by weighted fair queueing.

Every document waits in its source's queue, in an order shuffled by a keyed
digest.  Each round (epoch) of a source offers all its documents again.  The
virtual finish time of an offer is the source's words up to and with it,
divided by the source's target.  Offers of all sources are dealt into ranges of
finish time, summed range by range, and taken in that order while the running
total stays within the budget.  No step needs a source, or all offers, in one
task: both running totals are sums of hash or time ranges plus a running total
inside one range.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are returned with taken 0; rows that are
repeated are offered as often as they stand in the table; an empty table gives
an empty result.  Other columns of the input are passed over by ``mix`` and
kept by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, stored

#: Weights of sources in code point order, repeated as often as needed.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float, limit: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets of sources: source, source_size, n_docs in; target added.

    share of all words is dealt by weight.  No source gets more than limit times
    its own words; what it cannot take goes to the others by weight.  Sources
    sorted by the level (limit * size / weight) at which they fill up are full
    as far as the level of what is left exceeds theirs.  One row a source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(limit))).withColumn("fills_at", F.col("cap") / F.col("weight"))
    by_level = W.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    left = left.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"]
    return left.withColumn("open_level", level).select(
        "source", "source_size", "n_docs",
        F.when(F.col("open_level").isNull() | (F.col("fills_at") < F.col("open_level")), F.col("cap")).otherwise(F.col("weight") * F.col("open_level")).alias("target"),
    )


def mix(docs: DataFrame, *, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", rows_a_slice: int = 20_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs.

    taken is a function of (doc_id, source, size): rows that agree in all three
    share one place in the queue, and are one row until the end, so that an id
    (or none) that a third of the rows share costs no more than another.  finish
    is the virtual finish time of a document's first offer, null without words.
    """
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = stored(base.withColumn("turn", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))), "mix")
    rows = base.groupBy("doc_id", "source", "size", "turn", F.spark_partition_id().alias("part")).agg(F.count("*").alias("times"))
    rows = stored(rows, "mix-rows")
    base = rows.groupBy("doc_id", "source", "size", "turn").agg(F.sum("times").alias("times")).withColumn("words", F.col("size") * F.col("times"))
    # The first three digits of the digest deal a source's documents into 4,096
    # ranges, alike for any size of source; the order in them is by the whole.
    base = base.withColumn("range", F.substring("turn", 1, 3))
    sums = base.groupBy("source", "range").agg(F.sum("words").alias("range_size"), F.sum("times").alias("range_docs"))
    sizes = sums.groupBy("source").agg(F.sum("range_size").alias("source_size"), F.sum("range_docs").alias("n_docs"))
    targets = stored(source_targets(sizes, share, limit, weights), "mix-targets")
    total = targets.agg(F.sum("n_docs"), F.sum("source_size")).first()
    n_docs, budget = total[0] or 0, (total[1] or 0) * float(share)
    slices = int(min(65_536, max(256, -(-n_docs // rows_a_slice))))

    starts = sums.withColumn("range_start", F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("range_size"))
    ranges = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "range", "range_start", "source_size", "target")
    in_range = W.partitionBy("source", "range").orderBy("turn", "doc_id", "size").rangeBetween(W.unboundedPreceding, 0)
    queued = base.withColumn("upto", F.sum("words").over(in_range)).alias("q")
    queued = queued.join(ranges.alias("r"), F.expr("q.source <=> r.source AND q.range = r.range")).select("q.doc_id", "q.source", "q.size", "q.turn", "q.words", "source_size", "target", (F.col("range_start") + F.col("upto")).alias("upto"))
    queued = stored(queued, "mix-queue")

    epochs = range(math.ceil(limit))
    at = [F.when((F.col("target") > 0) & (F.col("size") > 0), (k * F.col("source_size") + F.col("upto")) / F.col("target")) for k in epochs]
    offers = queued.select("turn", "words", F.posexplode(F.array(*at)).alias("epoch", "at")).filter("at IS NOT NULL")
    # A source's words are even in finish time, so slices hold about as many words each.
    offers = offers.withColumn("slice", F.least(F.floor(F.col("at") * slices), F.lit(2 * slices)).cast("long"))
    by_slice = offers.groupBy("slice").agg(F.sum("words").alias("words"))
    by_slice = by_slice.withColumn("upto", F.sum("words").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, 0)))
    # The budget ends inside one slice: earlier ones are taken whole, later ones
    # not at all, and only that slice's offers are put in order.
    edge = by_slice.filter(F.col("upto") > budget).orderBy("slice").limit(1).first()
    if edge is None:
        last = (float("inf"), "", 0)
        before = 2**62
    else:
        before = edge["slice"]
        room = budget - (edge["upto"] - edge["words"])
        used = F.sum("words").over(W.orderBy("at", "turn", "epoch").rangeBetween(W.unboundedPreceding, 0))
        cut = offers.filter(F.col("slice") == before).withColumn("used", used).filter(F.col("used") <= room).agg(F.max(F.struct("at", "turn", "epoch")).alias("last")).first()["last"]
        last = tuple(cut) if cut else (-1.0, "", 0)

    def taken(k: int) -> Column:
        slice_ = F.least(F.floor(at[k] * slices), F.lit(2 * slices)).cast("long")
        in_time = (at[k] < last[0]) | ((at[k] == last[0]) & ((F.col("turn") < last[1]) | ((F.col("turn") == last[1]) & F.lit(k <= last[2]))))
        return F.when((slice_ < before) | ((slice_ == before) & in_time), F.col("size")).otherwise(0)

    plan = queued.select("doc_id", "source", "size", "source_size", "target", sum((taken(k) for k in epochs), F.lit(0)).cast("long").alias("taken"), at[0].alias("finish"))
    each = rows.alias("d").join(plan.alias("p"), F.expr("d.doc_id <=> p.doc_id AND d.source <=> p.source AND d.size = p.size"))
    each = each.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("p.doc_id", "p.source", "p.size", "source_size", "target", "taken", "finish")


def in_order(plan: DataFrame) -> DataFrame:
    """doc_id, source, size, epoch, finish: what a mix takes, one row an offer, in
    the order of virtual finish times (a range sort of all offers)."""
    epoch = F.explode(F.sequence(F.lit(0), (F.col("taken") / F.col("size")).cast("int") - 1))
    offers = plan.filter("taken > 0").withColumn("epoch", epoch)
    return offers.select("doc_id", "source", "size", "epoch", (F.col("finish") + F.col("epoch") * F.col("source_size") / F.col("target")).alias("finish")).orderBy("finish", "source", "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs, each row as often as the mix takes it (0 times: gone;
    a document without words, which costs nothing: once)."""
    plan = mix(docs, **how).select("doc_id", "source", "size", "taken").distinct()
    rows = docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).alias("d")
    joined = rows.join(plan.alias("p"), F.expr("d.doc_id <=> p.doc_id AND d.source <=> p.source AND d.__size = p.size"))
    times = F.expr("if(p.size > 0, cast(p.taken / p.size as int), 1)")
    joined = joined.withColumn("__times", times).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns])


#: The same in one statement: the queues and the cut need no ranges or slices there.
SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '-')) AS turn FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sized),
levels AS (
  SELECT *, cap / weight AS fills_at FROM ranked),
open AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM levels WINDOW b AS (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, fills_at) AS open_level FROM open WHERE level <= fills_at),
targets AS (
  SELECT source, source_size, CASE WHEN open_level IS NULL OR fills_at < open_level THEN cap ELSE weight * open_level END AS target
  FROM open LEFT JOIN chosen ON TRUE),
queued AS (
  SELECT b.*, t.source_size, t.target,
         (sum(b.size) OVER (PARTITION BY b.source ORDER BY b.turn, b.doc_id, b.size))::BIGINT AS upto
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
offers AS (
  SELECT q.*, e.epoch, (e.epoch * source_size + upto) / target AS due
  FROM queued q, (VALUES (0), (1)) e(epoch) WHERE size > 0 AND target > 0),
used AS (SELECT *, sum(size) OVER (ORDER BY due, turn, epoch) AS used FROM offers),
won AS (
  SELECT DISTINCT doc_id, source, size, epoch FROM used
  WHERE used <= (SELECT sum(source_size) * 1.5::DOUBLE FROM sized)),
words AS (SELECT doc_id, source, size, count(*) * size AS taken FROM won GROUP BY doc_id, source, size)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, coalesce(w.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN words w
ON q.doc_id IS NOT DISTINCT FROM w.doc_id AND q.source IS NOT DISTINCT FROM w.source AND q.size = w.size
"""

"""Uniform shuffle into shards of exact sizes, by a hypergeometric matrix.

How many rows each partition sends to each shard is drawn first, from the law
that a uniform shuffle of all rows follows (a multivariate hypergeometric one,
with shard sizes that differ by one at most).  Each partition then permutes its
own rows and deals them out by its line of the matrix; each shard permutes what
it received.  Partitions are ranges of a keyed hash of the whole row, so a task
that is run again deals the same rows, whatever the file layout.  A shard's own
permutation is done range by range, so no task holds a whole shard.

Law ``rows``: counts of shards differ by one at most; copies of one text are
shuffled like other rows.  Defined cases: a null text has size 1 and the crc32
of no bytes; null ids and repeated rows are rows like others; an empty table
gives an empty result.  Columns of the input are kept; ``shard`` and ``slot``
replace columns of those names, which take no part in the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import row_hash, stored

#: numpy draws from populations up to this size.
MOST = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws from good + bad are good: numpy's sampler as far as it
    goes, ratio of uniforms over the exact probabilities beyond."""
    if good + bad < MOST:
        return int(rng.hypergeometric(good, bad, draws)) if good and draws else 0
    if not good or not draws:
        return 0
    from math import lgamma, log, sqrt

    n = good + bad
    mean, var = draws * good / n, draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1))
    mode = int((draws + 1) * (good + 1) / (n + 2))
    lo, hi = max(0, draws - bad), min(draws, good)

    def weight(k: int) -> float:
        return -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(draws - k + 1) + lgamma(bad - draws + k + 1))

    top, half = weight(mode), 1.7155277699214135 * sqrt(var + 0.5) + 0.8989161620588988
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = int(np.floor(mean + half * (v - 0.5) / u + 0.5))
        if lo <= k <= hi and 2 * log(u) <= weight(k) - top:
            return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of partition p to shard s: uniform over all shuffles with these sums."""
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    total = sum(sizes)
    for count in counts:
        line, need, pool = [], count, total
        for s, free in enumerate(left):
            pool -= free
            k = need if s == len(left) - 1 else hypergeometric(rng, free, pool, need)
            line.append(k)
            need -= k
        left = [a - b for a, b in zip(left, line, strict=True)]
        total -= count
        out.append(line)
    return out


def shard(df: DataFrame, n_shards: int = 8, *, seed: int = 17, rows_a_partition: int = 100_000) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless from 0 in its shard)."""
    spark, df = df.sparkSession, df.drop("shard", "slot")
    # The matrix stays small: 65,536 lines at most.
    partitions = min(65_536, max(256, df.count() // rows_a_partition))
    rows = df.withColumn("__a", row_hash(df, seed)).withColumn("__b", row_hash(df, seed + 1))
    rows = rows.withColumn("__part", F.pmod(F.shiftrightunsigned("__a", 40), F.lit(partitions)).cast("int"))
    counts = dict(rows.groupBy("__part").count().collect())
    parts, total = sorted(counts), sum(counts.values())
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    bounds = [(p, [int(x) for x in np.cumsum(line)]) for p, line in zip(parts, matrix, strict=True)]
    dealt = spark.createDataFrame(bounds, "__part int, __ends array<long>")
    local = rows.withColumn("__n", F.row_number().over(W.partitionBy("__part").orderBy("__a", "__b")))
    # The matrix has partitions x shards numbers, whatever the input.
    out = local.join(F.broadcast(dealt), "__part").withColumn("__shard", F.size(F.filter("__ends", lambda e: e < F.col("__n"))).cast("int"))
    out = out.withColumn("__slice", F.pmod(F.shiftrightunsigned("__b", 40), F.lit(partitions)).cast("int"))
    out = out.drop("__part", "__ends", "__n")
    heights = out.groupBy("__shard", "__slice").agg(F.count("*").alias("__count"))
    starts = heights.withColumn("__start", F.sum("__count").over(W.partitionBy("__shard").orderBy("__slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("__count")).drop("__count")
    placed = out.withColumn("__n", F.row_number().over(W.partitionBy("__shard", "__slice").orderBy("__b", "__a")))
    # shards x partitions rows: a bound that does not grow with the input.
    placed = placed.join(F.broadcast(starts), ["__shard", "__slice"])
    slot = (F.col("__start") + F.col("__n") - 1).cast("long")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__shard").alias("shard"), slot.alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32: what the shuffle of whole rows is reported by."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def shard_digest(docs: DataFrame, n_shards: int = 8, **how) -> DataFrame:
    """Contract columns of the shuffle, over narrow rows that are stored once."""
    out = shard(stored(digest(docs), "shard"), n_shards, **how)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Words (runs of letters and digits, lower-cased) of all documents are scanned
   for the n-grams of the test items, a block of items at a time: what is
   broadcast is bounded by ``block_grams``, and more items mean more scans.  Of
   documents with a hit the places of their words in the block's vocabulary are
   stored, with the hits.
2. n-grams are told rare from common by all documents: common ones stand alone,
   with no other n-gram of the item near, in more than 8 documents and in more
   than one of 1,000.  A rare one is a seed: it joins every passage it stands in
   to its item.  A common one does so where another n-gram of the item is near.
   Around each group of hits the passage is as wide as a leak with them can be.
3. Passages that share too few words with their item for any alignment to count
   are dropped; no leak is lost by this bound.  The others are aligned (match 2,
   mismatch and gap -1).  A pair is a leak when the alignment reaches ``least`` of
   the score of the whole item, or holds ``run`` matching words at 80 % of its
   length.

A copy edited so often that no n words in a row are left unchanged has no hit and
is not seen, even where its alignment would reach ``least``; nor is one of which
a single common n-gram is all that is unchanged.

Defined cases: null or empty texts match nothing; items of fewer than n words
tell nothing and match nothing; rows that agree in doc_id and text are one row of
the result, items that agree in id and text are one item, and others count each,
also where ids are null (carried as null); of equal scores the leak with more
matches, then the first, is given; very long texts are scanned whole; an empty
table on either side gives an empty result.  Only doc_id, item_id and text are
read, so that other columns clash with nothing; clean() keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

TERM = re.compile(r"[^\W_]+")
def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two sequences of numbers (-1 matches nothing):
    score, matches, start and end in text."""
    n = len(text)
    score, hits, start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0, 0)
    ramp = np.arange(n + 1)
    for a in item:
        same = text == a
        diag = score[:-1] + np.where(same, 2, -1)
        up = score[1:] - 1
        take = diag >= up
        now = np.concatenate([[0], np.maximum(np.maximum(diag, up), 0)])
        h = np.concatenate([[0], np.where(take, hits[:-1] + same, hits[1:])])
        s = np.concatenate([[0], np.where(take, start[:-1], start[1:])])
        zero = now == 0
        h[zero], s[zero] = 0, ramp[zero]
        # A gap in the item: the best of score[j] - (i - j) over j < i.
        lead = np.maximum.accumulate(now + ramp)
        source = np.maximum.accumulate(np.where(now + ramp == lead, ramp, 0))
        gain = lead - ramp > now
        now, h, s = np.where(gain, lead - ramp, now), np.where(gain, h[source], h), np.where(gain, s[source], s)
        score, hits, start = now, h, s
        i = int(now.argmax())
        if now[i] > best[0]:
            best = (int(now[i]), int(h[i]), int(s[i]), i)
    return best


class Items:
    """A block of test items: words, n-grams and vocabulary as small arrays."""

    def __init__(self, items: list[tuple[int | None, str, int]], n: int) -> None:
        self.ids, self.keys_of = [i for i, _, _ in items], [k for _, _, k in items]
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in TERM.findall(t.lower())], np.int64) for _, t, _ in items]
        self.grams: dict[tuple, int] = {}
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.places: list[list[tuple[int, int]]] = []
        for i, w in enumerate(self.words):
            for at in range(len(w) - n + 1):
                g = self.grams.setdefault(tuple(w[at : at + n].tolist()), len(self.places))
                if g == len(self.places):
                    self.places.append([])
                self.places[g].append((i, at))
        keys = self._key(np.array(list(self.grams), np.int64).reshape(-1, n))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.table = np.array(list(self.grams), np.int64).reshape(-1, n)[self.order]

    def _key(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.int64)
        for c in grams.T:
            out = out * (len(self.vocabulary) + 1) % (2**61 - 1) + c + 1
        return out

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of items in words, and their places."""
        n = self.n
        if len(words) < n or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = words >= 0
        run = known[: len(words) - n + 1].copy()
        for i in range(1, n):
            run &= known[i : len(words) - n + 1 + i]
        at = np.flatnonzero(run)
        grams = np.stack([words[at + i] for i in range(n)], 1)
        key = self._key(grams)
        # Different n-grams of items may share a key: look at all of a key's.
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        found, place = [], []
        while (open_ := lo < hi).any():
            like = np.flatnonzero(open_)
            like = like[(self.table[lo[like]] == grams[like]).all(1)]
            found.append(self.order[lo[like]])
            place.append(at[like])
            lo = lo + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, place = np.concatenate(found), np.concatenate(place)
        first = np.argsort(place, kind="stable")
        return found[first], place[first]

    def most(self, item: int, words: np.ndarray) -> int:
        """No alignment of the item with words has more matches than this."""
        kinds, counts = self.counts[item]
        there = np.sort(words)
        return int(np.minimum(there.searchsorted(kinds, "right") - there.searchsorted(kinds), counts).sum())


def _scanned(docs: DataFrame, shared: Broadcast[Items]) -> DataFrame:
    """r1, r2, doc_id, words, grams, places of documents with a hit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        get = own.vocabulary.get
        for whole in batches:
            for part in range(0, whole.num_rows, 500):
                b, keep, words_, grams_, places_ = whole.slice(part, 500), [], [], [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    words = np.array([get(w, -1) for w in TERM.findall(text.lower())], np.int64) if text else np.zeros(0, np.int64)
                    grams, places = own.hits(words)
                    if len(grams):
                        keep.append(i)
                        words_.append(words.astype("<i4").tobytes())
                        grams_.append(grams.astype("<i4").tobytes())
                        places_.append(places.astype("<i4").tobytes())
                rows = b.select(["r1", "r2", "doc_id"]).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.binary()) for x in (words_, grams_, places_))], ["r1", "r2", "doc_id", "words", "grams", "places"])

    return docs.mapInArrow(scan, "r1 long, r2 long, doc_id long, words binary, grams binary, places binary")


def groups(own: Items, grams: np.ndarray, places: np.ndarray, least: float) -> Iterator[tuple[int, int, int, set[int]]]:
    """(item, from, to, n-grams) of hits of one item that are near each other, as
    wide as a leak with them can be."""
    found: dict[int, list[list]] = {}
    for g, at in zip(grams.tolist(), places.tolist(), strict=True):
        for item, place in own.places[g]:
            size = len(own.words[item])
            # With d words put in, a leak's score is 2 * size - d at most.
            margin = max(size // 4, math.ceil(2 * (1 - least) * size)) + 2
            lo, hi = at - place - margin, at - place + size + margin
            of = found.setdefault(item, [])
            # Hits far apart are other passages: a passage is at most 4 items long.
            if of and lo <= of[-1][1] and hi - of[-1][0] <= 4 * size + 16:
                of[-1][0], of[-1][1] = min(lo, of[-1][0]), max(hi, of[-1][1])
                of[-1][2].add(g)
            else:
                of.append([lo, hi, {g}])
    for item, each in found.items():
        for lo, hi, held in each:
            yield item, lo, hi, held


def _hits(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["grams"], "<i4"), np.frombuffer(row["places"], "<i4")


def _common(scanned: DataFrame, shared: Broadcast[Items], least: float, most: int) -> set[tuple[int, int]]:
    """(item, n-gram) that stand alone in more than ``most`` documents; no more of
    them than the block has words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, Counter()
        for b in batches:
            for r in b.to_pylist():
                total.update({(item, min(held)) for item, _, _, held in groups(own, *_hits(r), least) if len(held) == 1})
        pairs = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()), pa.array([g for _, g in pairs], pa.int32()), pa.array([total[p] for p in pairs], pa.int64())], ["item", "gram", "n"])

    alone = scanned.select("grams", "places").mapInArrow(count, "item int, gram int, n long").groupBy("item", "gram").agg(F.sum("n").alias("n"))
    return {(r["item"], r["gram"]) for r in alone.filter(F.col("n") > most).toLocalIterator()}


def passages(own: Items, common: set[tuple[int, int]], n_words: int, grams: np.ndarray, places: np.ndarray, least: float) -> Iterator[tuple[int, int, int]]:
    """(item, from, to) around hits that are seeds, or near another one."""
    for item, lo, hi, held in groups(own, grams, places, least):
        if len(held) > 1 or (item, min(held)) not in common:
            yield item, max(0, lo), min(n_words, hi)


LEAK = "r1 long, r2 long, doc_id long, item_id long, item long, score double, matched int, start int, end int"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, least: float = 0.5, run: int = 20, block_grams: int = 500_000) -> DataFrame:
    """doc_id, item_id, score (share of the item's own score), matched (words),
    start, end (in words of the document) of every leak, the best a document row
    and item; and r1, r2, 128 bits that tell the row."""
    spark = docs.sparkSession
    rows = docs.select(*_row(docs), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = [("r1", pa.int64()), ("r2", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    out, n_docs = None, docs.count()
    for block in item_blocks(benchmark, n, block_grams):
        shared = spark.sparkContext.broadcast(block)
        scanned = stored(_scanned(rows, shared), "leak-words")
        common = spark.sparkContext.broadcast(_common(scanned, shared, least, max(8, n_docs // 1000)))

        def judge(batches: Iterator[pa.RecordBatch], shared=shared, common=common) -> Iterator[pa.RecordBatch]:
            own, often = shared.value, common.value
            for whole in batches:
                for part in range(0, whole.num_rows, 500):
                    kept = []
                    for r in whole.slice(part, 500).to_pylist():
                        words = np.frombuffer(r["words"], "<i4")
                        for item, lo, hi in passages(own, often, len(words), *_hits(r), least):
                            size = len(own.words[item])
                            if own.most(item, words[lo:hi]) < min(least * size, run):
                                continue
                            score, matched, start, end = align(own.words[item], words[lo:hi])
                            if score >= least * 2 * size or matched >= run and matched >= 0.8 * (end - start):
                                kept.append((r["r1"], r["r2"], r["doc_id"], own.ids[item], own.keys_of[item], score / (2 * size), matched, lo + start, lo + end))
                    yield pa.RecordBatch.from_pylist([dict(zip([x for x, _ in kinds], r, strict=True)) for r in kept], schema=pa.schema(kinds))

        leaks = stored(scanned.mapInArrow(judge, LEAK), "leaks")
        discard(scanned)
        shared.unpersist()
        common.unpersist()
        out = leaks if out is None else out.union(leaks)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, matched int, start int, end int, r1 long, r2 long")
    # Passages of one row and item are few: a row's hits, merged by distance.
    best = F.max(F.struct("score", "matched", (-F.col("start")).alias("start"), "end"))
    out = out.groupBy("r1", "r2", "doc_id", "item_id", "item").agg(best.alias("b"))
    return out.select("doc_id", "item_id", "b.score", "b.matched", (-F.col("b.start")).alias("start"), "b.end", "r1", "r2")


def _row(docs: DataFrame) -> list:
    both = docs["doc_id"].cast("long"), docs["text"]
    return [F.xxhash64(*both).alias("r1"), F.xxhash64(F.lit(11), *both).alias("r2")]


def item_blocks(benchmark: DataFrame, n: int, block_grams: int) -> Iterator[Items]:
    """Items in blocks of at most block_grams words (one item at least), read one
    partition at a time."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    for r in items.withColumn("key", F.xxhash64("item_id", "text")).orderBy("item_id", "text").toLocalIterator():
        words = len(TERM.findall(r["text"]))
        if words < n:
            continue
        if block and size + words > block_grams:
            yield Items(block, n)
            block, size = [], 0
        block.append((r["item_id"], r["text"], r["key"]))
        size += words
    if block:
        yield Items(block, n)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows in which a test item leaked."""
    leaks = contaminated(docs, benchmark, **how).select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).distinct()
    r1, r2 = _row(docs)
    return docs.join(leaks, (r1 == F.col("__r1")) & (r2 == F.col("__r2")), "left_anti")

"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded, balanced sample of labelled documents is turned into counts of hashed
byte pairs and of a few marks of layout, weighted by log-frequency and inverse
document frequency, and reduced by a singular value decomposition.  The sample's
vectors (``sample`` x ``rank`` numbers, a fixed bound) are broadcast.  Every
document, over its whole text, is projected into the same space; exact cosines
to all labelled vectors come from one matrix product a block, and the labels of
the ``k`` nearest are averaged with their cosines to the power ``sharpness``, the
rarer label's by more (its share to the power ``-balance``).

Defined cases: a null or empty text, or one without any known feature, gets the
score 0.5 (or the only label there is); without any label every score is 0.5.  Labels that are null, and of a doc_id
whose labels disagree, are not learned from; where rows share a doc_id one text
of theirs (the first by a hash) is learned from and each is scored by its own;
of neighbours at equal cosine those of the least doc_id vote.  Only doc_id and
text are read, so other columns clash with nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

PAIRS = 1024
#: Layout marks after the byte pairs, in steps of their share: kinds of bytes,
#: repeated lines, words repeated at once, words a line, length of words.
MARKS = 96
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1  # capitals
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 5
_CLASS[128:] = 6


def features(text: bytes) -> np.ndarray:
    """Counts of PAIRS hashed byte pairs, then MARKS layout marks."""
    out = np.zeros(PAIRS + MARKS, np.float32)
    if not text:
        return out
    b = np.frombuffer(text, np.uint8)
    if len(b) > 1:
        pair = (b[:-1].astype(np.uint32) << 8 | b[1:]) * np.uint32(2654435761) >> np.uint32(22)
        out[:PAIRS] = np.bincount(pair, minlength=PAIRS)
    share = np.bincount(_CLASS[b], minlength=7) / len(b)
    step = np.minimum((share * 40).astype(int), 7)
    for i in range(7):
        out[PAIRS + 8 * i + step[i]] = 4
    lines = [x for x in text.split(b"\n") if x]
    again = 1 - len(set(lines)) / max(1, len(lines))
    out[PAIRS + 56 + min(7, int(again * 8))] = 4
    words = text.split()
    same = sum(map(eq, words, islice(words, 1, None))) / max(1, len(words))
    out[PAIRS + 64 + min(7, int(same * 16))] = 12
    out[PAIRS + 72 + min(7, int(len(words) / (len(lines) or 1) / 16))] = 2
    out[PAIRS + 80 + min(7, len(text) // (len(words) or 1) // 2)] = 4
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, a_class: int) -> DataFrame:
    """doc_id, text, label of at most a_class documents of each of two classes,
    the first by a hash of doc_id.  Ids whose labels disagree are left out; of
    rows that share an id, the text that is first by its hash is taken."""
    one = F.col(label).cast("int")
    said = labels.filter(usable & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(one).alias("label"), F.max(one).alias("other"))
    chosen = said.filter("label = other AND doc_id IS NOT NULL").select("doc_id", "label")
    order = F.xxhash64(F.lit(label), "doc_id")
    parts = [chosen.filter(F.col("label") == y).orderBy(order, "doc_id").limit(a_class) for y in (0, 1)]
    # Bounded: 2 x a_class ids.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


class Space:
    """What a fit on (features, labels) leaves: small arrays only."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int, k: int, sharpness: float, balance: float) -> None:
        self.k, self.sharpness = k, sharpness
        self.labels = labels.astype(np.float32)
        # The rarer label's votes weigh more, by a power of its share.
        share = np.array([1 - self.labels.mean(), self.labels.mean()]) if len(labels) else np.ones(2)
        self.worth = (np.maximum(share, 1e-9) ** -balance)[labels.astype(int)].astype(np.float32)
        self.prior = 0.5 if share.min() > 0 else float(share[1] > 0)
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
        x = self.weigh(counts)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
        self.known = self.unit(x @ self.basis)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return self.unit(np.log1p(counts) * self.idf)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.unit(self.weigh(counts) @ self.basis) @ self.known.T
        k = min(self.k, len(self.labels))
        kth = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        # All that are as near as the k-th vote, so that ties need no order.
        weight, near = np.zeros_like(cosine), (cosine >= kth) & (cosine > 0)
        weight[near] = cosine[near] ** self.sharpness
        weight *= self.worth
        total = weight.sum(1, dtype=np.float64)
        vote = (weight @ self.labels) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 1e-9, vote, self.prior), 0, 1).astype(float)


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "quality", sample: int = 4000, rank: int = 64, k: int = 15, sharpness: float = 8.0, balance: float = 0.5) -> Space:
    """Fit on at most ``sample`` labelled documents; only their counts, of fixed
    length, come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([features(x).tobytes() for x in text_bytes(b.column("text"))], pa.binary())], ["label", "counts"])

    rows = labelled_sample(docs, labels, label, usable, sample // 2).mapInArrow(counted, "label int, counts binary").collect()
    counts = np.array([np.frombuffer(r["counts"], np.float32) for r in rows]).reshape(len(rows), PAIRS + MARKS)
    return Space(counts, np.array([r["label"] for r in rows]), rank, k, sharpness, balance)


def score_quality(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                counts = np.array([features(x) for x in text_bytes(b.column("text"))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(counts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")

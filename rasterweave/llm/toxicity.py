"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences.  A sentence is toxic with probability
sigmoid(bias + sum of its marks' weights); a document with 1 - prod(1 - p), the
noisy-or.  Marks are words and word beginnings.  Weights are trained by gradient
ascent on document labels alone, over a bounded sample (``sample`` documents,
whole texts); no sentence is ever labelled.  Only marks of at least
``least_docs`` sampled documents that toxic ones hold more often are used,
``most_marks`` at most.  Trained sentence probabilities then locate the
offending sentences in any text.

Marks are counted in tasks.  What comes to the driver is bounded: the chosen
marks, and for the sampled documents the numbers of the chosen marks in each of
their sentences, ``most_numbers`` at most (documents beyond that, in the
sample's order, are not learned from).  No text does.

Words are runs of letters, lower-cased.  Sentences end at ``.``, ``!``, ``?``
and line ends.  Defined cases: a null or empty text has no sentence and scores
0; without labels of both kinds nothing is toxic (all scores 0); labels that are
null, and of a doc_id whose labels disagree, are not learned from; where rows
share a doc_id one text of theirs (the first by a hash) is learned from, and
each is scored by its own; very long texts are learned from and scored whole;
columns named tox_score or tox_spans are replaced, others kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .quality import labelled_sample

SENTENCE = re.compile(r"[^.!?\n]+")
TERM = re.compile(r"[^\W\d_]+")
#: Words that a task remembers before it starts afresh.
REMEMBERED = 100_000


def marks(word: str) -> list[str]:
    """What a word is known by: itself, and its first 4 to 8 letters."""
    return [word + "$", *(word[:n] for n in range(4, min(8, len(word)) + 1))]


def bags(text: str | None) -> list[list[str]]:
    """The sentences of a text as their distinct lower-case words."""
    return [sorted(set(TERM.findall(s))) for s in SENTENCE.findall((text or "").lower())]


def train(doc: np.ndarray, sent: np.ndarray, col: np.ndarray, labels: np.ndarray, n_marks: int, *, rounds: int = 400, decay: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of marks and the bias, by adaptive gradient ascent on the noisy-or
    likelihood: sentence i is of document doc[i]; entry j says that sentence
    sent[j] holds mark col[j]."""
    n_docs, n_sents = len(labels), len(doc)
    w, bias, memory_w, memory_b = np.zeros(n_marks), -3.0, np.full(n_marks, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(bias + np.bincount(sent, w[col], n_sents))))
        toxic = -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs))
        # d log-likelihood / d z: -p in clean bags, p (1 - P) / P in toxic ones.
        pull = np.where(labels == 1, (1 - toxic) / np.maximum(toxic, 1e-12), -1.0)
        grad_z = p * pull[doc]
        grad_w = np.bincount(col, grad_z[sent], n_marks) - decay * w
        grad_b = grad_z.sum()
        memory_w += grad_w**2
        memory_b += grad_b**2
        w += 0.3 * grad_w / np.sqrt(memory_w)
        bias += 0.3 * grad_b / np.sqrt(memory_b)
    return w, float(bias)


class NoisyOr:
    """Weights of marks and a bias; a few thousand numbers."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.memo: dict[str, tuple[str, ...]] = {}

    def known(self, word: str) -> tuple[str, ...]:
        """The weighted marks of a word."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            found = self.memo[word] = tuple(m for m in marks(word) if m in self.weights)
        return found

    def weight(self, words: set[str]) -> float | None:
        """Log odds of a sentence of these lower-case words; None without a mark."""
        own: set[str] = set()
        for known in map(self.known, words):
            if known:
                own.update(known)
        return self.bias + sum(sorted(self.weights[m] for m in own)) if own else None

    def score(self, text: str) -> float:
        """Noisy-or over the sentences that hold a mark; others count as clean."""
        if not self.weights:
            return 0.0
        low = text.lower()
        if not any(map(self.known, set(TERM.findall(low)))):
            return 0.0
        odds = [z for s in SENTENCE.findall(low) if (z := self.weight(set(TERM.findall(s)))) is not None]
        return float(-np.expm1(-np.sum(np.logaddexp(0, odds)))) if odds else 0.0

    def sentence(self, text: str) -> float:
        z = self.weight(set(TERM.findall(text.lower())))
        return 0.0 if z is None else 1 / (1 + float(np.exp(-z)))

    def locate(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Spans (start, end, probability) of sentences of at least that probability."""
        found = ((m.start(), m.end(), self.sentence(m.group())) for m in SENTENCE.finditer(text))
        return [x for x in found if x[2] >= least]


def chosen_marks(rows: DataFrame, least_docs: int, most_marks: int) -> list[str]:
    """Of marks that toxic documents hold more often, the best by likelihood ratio."""
    kinds = pa.schema([("mark", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b, seen = whole.slice(at, 100), (Counter(), Counter())
                for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                    seen[y].update({m for w in set().union(*bags(text)) for m in marks(w)})
                every = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[m] for m in every], pa.int64()) for c in seen)], schema=kinds)

    n, n_toxic = rows.agg(F.count("*"), F.sum("label")).first()
    if not 0 < (n_toxic or 0) < n:
        return []
    share = n_toxic / n
    counts = rows.mapInArrow(counted, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("rest"), F.sum("toxic").alias("toxic"))
    held = F.col("toxic") + F.col("rest")
    rated = counts.filter((held >= least_docs) & (F.col("toxic") > held * share))
    clean_part = F.when(F.col("rest") > 0, F.col("rest") * F.log(F.col("rest") / (held * (1 - share)))).otherwise(0.0)
    rated = rated.withColumn("gain", F.col("toxic") * F.log(F.col("toxic") / (held * share)) + clean_part).filter("gain > 3")
    return [r["mark"] for r in rated.orderBy(F.desc("gain"), "mark").limit(most_marks).collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, *, label: str = "toxic", sample: int = 6000, least_docs: int = 3, most_marks: int = 4000, most_numbers: int = 4_000_000, **how) -> NoisyOr:
    """Fit on the whole texts of at most ``sample`` documents."""
    sc = docs.sparkSession.sparkContext
    rows = stored(labelled_sample(docs, labels, label, usable, sample // 2), "tox-sample")
    place = {m: i for i, m in enumerate(chosen_marks(rows, least_docs, most_marks))}
    if not place:
        discard(rows)
        return NoisyOr({}, -30.0)
    shared = sc.broadcast(place)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b, cols, sizes = whole.slice(at, 100), [], []
                for text in b.column("text").to_pylist():
                    held = [x for s in bags(text) if (x := sorted({own[m] for w in s for m in marks(w) if m in own}))]
                    cols.append(np.array([i for x in held for i in x], "<i4").tobytes())
                    sizes.append(np.array([len(x) for x in held], "<i4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([len(x) // 4 for x in cols], pa.int64()), pa.array(cols, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "label", "n", "cols", "sizes"])

    found = stored(rows.mapInArrow(numbered, "doc_id long, label int, n long, cols binary, sizes binary"), "tox-marks")
    # One narrow row a sampled document tells how many of them fit the bound.
    order = (F.xxhash64(F.lit(label), "doc_id"), F.col("doc_id"))
    upto = np.cumsum([r["n"] for r in found.select("n", *[c.alias(f"o{i}") for i, c in enumerate(order)]).orderBy("o0", "o1").collect()])
    used = found.orderBy(*order).limit(int((upto <= most_numbers).sum())).collect()
    labels_ = np.array([r["label"] for r in used])
    sizes = [np.frombuffer(r["sizes"], "<i4") for r in used]
    doc = np.repeat(np.arange(len(used)), [len(x) for x in sizes])
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    sent = np.repeat(np.arange(len(size)), size)
    col = np.concatenate([np.frombuffer(r["cols"], "<i4") for r in used]).astype(np.int64) if used else np.zeros(0, np.int64)
    shared.unpersist()
    discard(rows)
    discard(found)
    if not 0 < labels_.sum() < len(labels_):
        return NoisyOr({}, -30.0)
    del used
    w, bias = train(doc, sent, col, labels_, len(place), **how)
    return NoisyOr({m: float(w[i]) for m, i in place.items() if abs(w[i]) > 0.02}, bias)


def score_toxicity(docs: DataFrame, model: NoisyOr, *, spans: bool = False) -> DataFrame:
    """docs with tox_score, and with spans also tox_spans: where (in characters)
    and how probable its toxic sentences are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "tox_score double" + ", tox_spans array<struct<start:int,end:int,probability:double>>" * spans

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            scores = [own.score(x) for x in texts]
            columns, names = [*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "tox_score"]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
                columns.append(pa.array([[{"start": s, "end": e, "probability": p} for s, e, p in (own.locate(x) if score >= 0.5 else ())] for x, score in zip(texts, scores, strict=True)], kind))
                names.append("tox_spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    clash = [c for c in ("tox_score", "tox_spans") if c in docs.columns]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(*clash).schema.fields)
    return docs.drop(*clash).mapInArrow(scored, f"{ddl}, {fields}")

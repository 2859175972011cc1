"""Toxicity severity by cumulative-link ordinal regression.

Features are hashed words, present or not; one weight vector is shared by all
ordered thresholds: P(grade >= j) = sigmoid(w . x - t_j).  Words enter by the
evidence of each (an exact test, with a bound on the share of false ones);
weights are sparse (L1, accelerated proximal gradient).  The bound and the
weights of L1 and L2 are chosen by cross-validation within the labels.  A
document's severity is its expected grade, the sum of those probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwise.llm import _learn, _text

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
BUCKETS = 1 << 18
#: Choices for cross-validation: expected share of false words among those that
#: enter; L1 weight in standard errors of each word's own gradient, so that a rare
#: word is held to the same evidence as a frequent one; L2 weight times the
#: sample's size.
FALSE_WORDS, L1S, L2S = (0.05, 0.2, 0.5), (0.0, 0.5, 1.0), (0.03, 0.1, 0.3, 1.0)
FOLDS = 5
STEPS = 200


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Buckets of all words (runs of letters), offsets per document, rows."""
    for part in _text.slices(texts):
        starts, ends, first = part.words(_text.LETTERS)
        yield (part.word_hashes(starts, ends) % np.uint64(BUCKETS)).astype(np.int64), first, part.n


@dataclass
class Model:
    """Grades in order, weights by bucket and the rising thresholds."""

    grades: list[int]
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(BUCKETS)
        dense[self.buckets] = self.weights
        used = dense != 0
        out = []
        for words, first, n in _features(texts):
            # Only words that weigh anything, each once per document.
            at = np.flatnonzero(used[words])
            doc = np.searchsorted(first, at, side="right") - 1
            key = np.unique(doc * BUCKETS + words[at])
            out.append(np.bincount(key // BUCKETS, weights=dense[key % BUCKETS], minlength=n))
        x = np.concatenate(out) if out else np.zeros(0)
        return sum((1 / (1 + np.exp(np.clip(t - x, -500, 500))) for t in self.thresholds), np.zeros(len(x)))


def _false_shares(doc: np.ndarray, at: np.ndarray, n: int, above: np.ndarray) -> np.ndarray:
    """For each of n words the share of false ones to expect among all words of
    as much evidence or more.

    Evidence is the exact two-sided hypergeometric chance that so many of a
    word's documents reach a grade; what is expected by accident is summed over
    the chances each word can have at all (Heyse), so rare words cost nothing."""
    rows, m = len(above), np.bincount(at, minlength=n)
    sizes, group, words = np.unique(m, return_inverse=True, return_counts=True)
    log = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, rows + 1)))))
    found, tables = np.ones((above.shape[1], n)), []
    order = np.argsort(group, kind="stable")
    of_size = np.split(order, np.cumsum(words)[:-1])
    for c, y in enumerate(above.T):
        hits, k = int(y.sum()), np.bincount(at, weights=y[doc], minlength=n).astype(np.int64)
        for size, number, of in zip(sizes, words, of_size):
            j = np.arange(max(0, size + hits - rows), min(size, hits) + 1)
            p = np.exp(log[hits] - log[j] - log[hits - j] + log[rows - hits] - log[size - j] - log[rows - hits - size + j] - log[rows] + log[size] + log[rows - size])
            chance = np.minimum(1.0, 2 * np.minimum(np.cumsum(p), np.cumsum(p[::-1])[::-1]))
            found[c, of] = chance[k[of] - j[0]]
            tables.append((chance, p * number))
    steps, place = np.unique(found, return_inverse=True)
    chance, weight = (np.concatenate(x) for x in zip(*tables))
    # A step counts what lies at it, up to rounding.
    false = np.bincount(np.searchsorted(steps * (1 + 1e-9), chance), weights=weight, minlength=len(steps) + 1)[: len(steps)].cumsum()
    share = np.minimum.accumulate((false / np.bincount(place.ravel()).cumsum())[::-1])[::-1]
    return share[place.reshape(found.shape)].min(axis=0)


def _fitted(doc: np.ndarray, at: np.ndarray, false: np.ndarray, above: np.ndarray, most: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words used, their weights and the thresholds."""
    rows, rate, n = len(above), above.mean(axis=0), len(false)
    keep = np.flatnonzero(false <= most)
    if l1:
        kd, ka = _among(doc, at, n, keep)
        share = np.bincount(ka, minlength=len(keep)) / rows
        error = np.sqrt(share * (1 - share) * (rate * (1 - rate)).sum() / rows)
        keep = keep[_descend(kd, ka, len(keep), above, l1 * error, 0.0)[0] != 0]
    # The L1 weight chose the features; without it their weights aren't shrunk.
    return keep, *_descend(*_among(doc, at, n, keep), len(keep), above, 0.0, l2 / rows)


def _among(doc: np.ndarray, at: np.ndarray, n: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the kept words, by their places among these."""
    place = np.full(n, -1)
    place[keep] = np.arange(len(keep))
    used = place[at] >= 0
    return doc[used], place[at[used]]


def _chosen(doc: np.ndarray, at: np.ndarray, n: int, above: np.ndarray, fold: np.ndarray) -> tuple[float, float, float]:
    """The choice with the least log loss on held-out documents, with words and
    weights from the others only: one strength after another, from the middle."""
    parts = []
    for f in range(FOLDS):
        seen = fold != f
        used, row = seen[doc], np.cumsum(seen) - 1
        false = _false_shares(row[doc[used]], at[used], n, above[seen])
        some = false[at] <= max(FALSE_WORDS)
        parts.append((seen, row, false, doc[some], at[some]))

    def loss(choice: list[float]) -> float:
        total = 0.0
        for seen, row, false, d, a in parts:
            used = seen[d]
            keep, w, t = _fitted(row[d[used]], a[used], false, above[seen], *choice)
            kd, ka = _among(d, a, n, keep)
            x = np.bincount(kd, weights=w[ka], minlength=len(above))[~seen]
            total += np.logaddexp(0, np.where(above[~seen] > 0, -1, 1) * (x[:, None] - t[None, :])).sum()
        return total

    best = [0.2, 0.0, 0.1]
    least = loss(best)
    for i, values in enumerate((FALSE_WORDS, L1S, L2S)):
        for v in values:
            tried = [*best[:i], v, *best[i + 1 :]]
            if v != best[i] and (got := loss(tried)) < least:
                best, least = tried, got
    return tuple(best)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """rows: distinct buckets of each document; y: its grade.  With fewer than
    two grades severity is 0 throughout."""
    grades = sorted({int(v) for v in y})
    if len(grades) < 2:
        return Model(grades, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    kinds, at = np.unique(flat, return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    above = np.array([[v >= g for g in grades[1:]] for v in y], dtype=float)
    # Folds by what a document holds: copies of one text never face each other.
    fold = np.array([zlib.crc32(np.ascontiguousarray(r, np.int64).tobytes()) % FOLDS for r in rows])
    keep, w, t = _fitted(doc, at, _false_shares(doc, at, len(kinds), above), above, *_chosen(doc, at, len(kinds), above, fold))
    return Model(grades, kinds[keep], w, t)


def _descend(doc: np.ndarray, at: np.ndarray, n: int, above: np.ndarray, l1: np.ndarray | float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient steps; features
    that many documents hold have more curvature and take smaller steps."""
    rows, rate = len(above), above.mean(axis=0)
    w, t = np.zeros(n), -np.log((rate + 1e-6) / (1 - rate + 1e-6))
    curve = np.bincount(at, minlength=n) / rows * 0.25 * above.shape[1] * 12 + l2 + 1e-9
    vw, vt, k = w.copy(), t.copy(), 1.0
    for _ in range(STEPS):
        x = np.bincount(doc, weights=vw[at], minlength=rows)
        gap = 1 / (1 + np.exp(np.clip(vt[None, :] - x[:, None], -500, 500))) - above
        slope = np.bincount(at, weights=gap.sum(axis=1)[doc], minlength=n) / rows + l2 * vw
        new = vw - slope / curve
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0)
        new_t = np.maximum.accumulate(vt + gap.mean(axis=0) * 2)
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        if ((new - w) * (vw - new)).sum() > 0:
            k2 = 1.0  # momentum points uphill: start it anew
        vw, vt = new + (k - 1) / k2 * (new - w), new_t
        w, t, k = new, new_t, k2
    return w, t


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.unique(words[first[i] : first[i + 1]]) for words, first, n in _features(b.column(0)) for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["label", "x"])

    rows = _learn.labelled(docs, labels.withColumn("toxic", F.col("toxic").cast("int")), "toxic", sample)
    got = rows.mapInArrow(run, "label int, x array<long>").toPandas()
    return fit([np.asarray(x, dtype=np.int64) for x in got["x"]], got["label"].to_numpy())


def graded(docs: DataFrame, model: Model, into: str = "__severity", grade: str = "__grade") -> DataFrame:
    """`docs` with the expected severity (0 to the number of thresholds) as column
    `into` and the same rounded as `grade` (columns of these names are replaced, all
    others stay).

    Null, empty and word-less texts hold no feature and are graded by the
    thresholds alone; equal texts are graded alike, however often a row is repeated;
    very long texts count whole; a model without two grades gives 0; an empty table
    gives an empty result."""

    @F.arrow_udf("double")
    def severity(text: pa.Array) -> pa.Array:
        return pa.array(model.severity(text), pa.float64())

    rows = docs.withColumn(into, severity("text"))
    return rows.withColumn(grade, F.floor(F.col(f"`{into}`") + 0.5).cast("int"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return graded(docs, model).select("doc_id", F.col("__severity").alias("severity"), F.col("__grade").alias("grade"), (F.col("__grade") > 0).alias("toxic"))

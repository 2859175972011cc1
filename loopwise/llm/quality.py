"""Document quality by regularised quadratic discriminant analysis.

Statistics of the whole text are transformed towards normal shape; each class
has its own covariance, shrunk towards the pooled one and a multiple of the
identity.  Scores come from the difference of the two log densities, whose
Mahalanobis terms use Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwise.llm import _learn, _text

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Shares of the pooled covariance and of the identity in a class's covariance.
TO_POOLED, TO_IDENTITY = 0.2, 0.05

FEATURES = 12

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'\"-()"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_text.LETTERS | _DIGIT | _STOP)
_LINE = np.ones(256, bool)
_LINE[10] = False


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows x features, transformed: logs of counts, roots of shares."""
    out = []
    for part in _text.slices(texts):
        starts, ends, first = part.words()
        n = np.diff(first).astype(float)
        size = np.diff(part.offsets).astype(float)

        def sums(mask: np.ndarray, part=part) -> np.ndarray:
            run = np.concatenate(([0], np.cumsum(mask[part.raw], dtype=np.int64)))
            return np.diff(run[part.offsets]).astype(float)

        length = np.concatenate(([0.0], np.cumsum(ends - starts, dtype=float)))
        square = np.concatenate(([0.0], np.cumsum((ends - starts) ** 2, dtype=float)))
        mean = _share(length[first[1:]] - length[first[:-1]], n)
        spread = np.sqrt(np.maximum(_share(square[first[1:]] - square[first[:-1]], n) - mean**2, 0))
        words = part.word_hashes(starts, ends)
        pairs = _text.shingle_hashes(words, 3)
        line_s, line_e, line_first = part.words(_LINE)
        lines = part.word_hashes(line_s, line_e)
        distinct, repeated, same_lines, top = (np.zeros(part.n) for _ in range(4))
        for i in range(part.n):
            a, b = first[i], first[i + 1]
            if b > a:
                _, counts = np.unique(words[a:b], return_counts=True)
                distinct[i] = len(counts) / np.sqrt(b - a)
                top[i] = counts.max() / (b - a)
            if b - a > 3:
                repeated[i] = 1 - len(np.unique(pairs[a : b - 2])) / (b - 2 - a)
            c, d = line_first[i], line_first[i + 1]
            if d > c:
                same_lines[i] = 1 - len(np.unique(lines[c:d])) / (d - c)
        letters = sums(_text.LETTERS)
        out.append(
            np.column_stack(
                [
                    np.log1p(n),
                    np.log1p(mean),
                    np.log1p(spread),
                    np.sqrt(_share(sums(_UPPER), letters)),
                    np.sqrt(_share(sums(_DIGIT), size)),
                    np.sqrt(_share(sums(_STOP), size)),
                    np.sqrt(_share(sums(_SYMBOL), size)),
                    np.log1p(_share(np.diff(line_first).astype(float), n) * 100),
                    np.log1p(distinct),
                    np.sqrt(repeated),
                    np.sqrt(same_lines),
                    np.sqrt(top),
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


@dataclass
class Model:
    """Two normal densities; `factors` are inverse Cholesky factors."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if not self.means:
            return np.full(len(x), self.offsets[0])
        z = np.clip((x - self.center) / self.scale, -8, 8)
        log = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without rows of both classes every score is the share of label 1, or 1
    if there are no rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(np.zeros(0), np.ones(0), [], [], [float(y.mean()) if len(y) else 1.0])
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - center) / scale, -8, 8)
    groups = [z[y == k] for k in (0, 1)]
    pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups) / len(z)
    means, factors, offsets = [], [], []
    for g in groups:
        own = np.cov(g.T, bias=True)
        c = (1 - TO_POOLED - TO_IDENTITY) * own + TO_POOLED * pooled + TO_IDENTITY * np.trace(own) / len(own) * np.eye(len(own))
        lower = np.linalg.cholesky(c + 1e-4 * np.eye(len(c)))
        means.append(g.mean(axis=0))
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(len(g) / len(z)) - np.log(np.diag(lower)).sum()))
    return Model(center, scale, means, factors, offsets)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int | None = 5) -> Model:
    """Fits on at most `sample` labelled documents: their statistics, a dozen
    numbers each, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    rows = _learn.labelled(docs, labels.withColumn("quality", F.col("quality").cast("int")), "quality", sample, held_out)
    got = rows.mapInArrow(run, "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, FEATURES))
    return fit(x, got["label"].to_numpy())


def score(model: Model):
    """A column function of a text: the probability of label 1.  Null text counts
    as empty."""

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        return pa.array(model.scores(statistics(text)), pa.float64())

    return of


def scored(docs: DataFrame, model: Model, into: str = "__score") -> DataFrame:
    """`docs` with the score of each row's whole text as column `into` (a column of
    that name is replaced; all others stay).

    Null, empty and word-less texts are scored by their statistics, all 0; equal
    texts score alike, however often a row is repeated; a row is judged by itself,
    so very long texts need room for their own words only; an empty table gives an
    empty result."""
    return docs.withColumn(into, score(model)("text"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(docs, model).select("doc_id", (_learn.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__score").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))

"""Quality classifier learned from positive and unlabelled texts.

Trusted positives are texts labelled good; everything else is unlabelled web text.
The share of good texts among the unlabelled is estimated first.  The classifier then
minimises the non-negative unbiased risk: the risk on positives, plus the risk of
calling unlabelled text negative less what the positives in it contribute, the
latter never allowed to fall below zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attestry.llm.common import ROW, packed

# Rows the classifier is fitted on, about: so many positives and so many unlabelled.
SAMPLE_ROWS = 8_000
RATIO_QUANTILE = 0.7
THRESHOLD = 0.3  # fixed value of the contract
SEED = 11

# Byte classes whose shares describe a text.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?",
    b"#*$%&", b"|<>{}[]\\^~=_+@/", b"\"'()-`",
)
KIND = np.full(256, len(CLASSES), np.uint8)
for _k, _members in enumerate(CLASSES):
    KIND[list(_members)] = _k
WIDTH = len(CLASSES) + 1


def text_features(text: bytes) -> list[float]:
    """Shares of byte classes, and how words and lines repeat; defined for empty texts."""
    size = max(1, len(text))
    shares = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=WIDTH) / size
    words = text.split()
    n = max(1, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    rows = max(1, len(lines))
    kinds = len(set(words))
    runs = sum(map(bytes.__eq__, words, words[1:]))
    return [
        *shares.tolist(), np.log1p(len(words)), len(text) / n / 10, kinds / n, np.log1p(n) - np.log1p(kinds), runs / n,
        1 - len(set(lines)) / rows, np.log1p(len(lines)), np.log1p(n / rows), float(not words),
    ]


def expanded(raw: np.ndarray) -> np.ndarray:
    """Features with square roots, which part small shares from none."""
    return np.hstack([raw, np.sqrt(np.abs(raw[:, :WIDTH]))])


@dataclass
class Model:
    """A standardised input, one hidden layer and a logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margins(self, raw: np.ndarray) -> np.ndarray:
        x = np.clip((expanded(raw) - self.mean) / self.scale, -8, 8)
        return forward(self.weights, x)[1]

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(raw), -30, 30)))


def forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner, bias, outer, shift = weights
    hidden = np.tanh(x @ inner + bias)
    return hidden, hidden @ outer + shift[0]


def descend(x: np.ndarray, slopes, rounds: int, hidden: int, decay: float = 1e-2, rate: float = 0.01) -> list[np.ndarray]:
    """Adam on the network; ``slopes(margins)`` gives d risk / d margin of every row."""
    rng = np.random.default_rng(SEED)
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        inner, margins = forward(weights, x)
        g = slopes(margins)
        back = np.outer(g, weights[2]) * (1 - inner * inner)
        gradients = [x.T @ back + decay * weights[0], back.sum(axis=0), inner.T @ g + decay * weights[2], np.array([g.sum()])]
        for k, gradient in enumerate(gradients):
            first[k] += 0.1 * (gradient - first[k])
            second[k] += 0.01 * (gradient * gradient - second[k])
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return weights


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(x: np.ndarray, positive: np.ndarray, rounds: int = 150, hidden: int = 8) -> float:
    """Share of positives among the unlabelled rows.

    A classifier of positive against unlabelled rows estimates the density ratio
    p(x | good) / p(x), which is at most 1 / prior and reaches it where only good
    texts lie.  Each half of the rows is judged by a classifier fitted on the other;
    a quantile above the median of the positives' ratios leans against noise below
    the bound and is kept from the noise above it.
    """
    ratios = []
    for half in (np.arange(len(x)) % 2 == 0, np.arange(len(x)) % 2 == 1):
        n_pos, n_all = (positive & half).sum(), (~positive & half).sum()
        weight = np.where(positive, 0.5 / max(1, n_pos), 0.5 / max(1, n_all))[half]
        weights = descend(x[half], lambda m: weight * (sigmoid(m) - positive[half]), rounds, hidden)
        ratios.append(np.exp(np.clip(forward(weights, x[~half & positive])[1], -10, 10)))
    every = np.concatenate(ratios)
    return float(np.clip(1 / np.quantile(every, RATIO_QUANTILE), 0.05, 0.95)) if len(every) else 0.5


def fit_arrays(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None,
               rounds: int = 400, hidden: int = 16) -> Model:
    raw = np.vstack([positives, unlabelled])
    wide = expanded(raw)
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-3
    x = np.clip((wide - mean) / scale, -8, 8)
    positive = np.arange(len(raw)) < len(positives)
    prior = class_prior(x, positive) if prior is None else prior
    share_pos, share_all = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())

    def slopes(margins: np.ndarray) -> np.ndarray:
        good = sigmoid(margins)
        # Logistic losses: of calling a row bad, log(1 + exp(margin)).
        as_bad = np.logaddexp(0, margins)
        negative_risk = share_all @ as_bad - prior * (share_pos @ as_bad)
        negative = share_all * good - prior * share_pos * good
        if negative_risk < 0:  # the part below zero is walked back instead of down
            return -negative
        return prior * share_pos * (good - 1) + negative

    return Model(mean, scale, descend(x, slopes, rounds, hidden), prior)


def feature_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t) for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["features"])


def sample_features(docs: DataFrame, ids: DataFrame, rows: int) -> np.ndarray:
    """Feature rows of about ``rows`` of the documents that ``ids`` names, chosen by hash.

    The ids that are sent to every executor are the sample itself.
    """
    step = max(1, ids.count() // max(1, rows))
    chosen = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).distinct()
    some = docs.join(F.broadcast(chosen), "doc_id").select("text")
    table = some.mapInArrow(feature_batches, "features array<double>").toArrow()
    return np.array(table.column("features").to_pylist(), float).reshape(-1, len(text_features(b"")))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """``docs`` with doc_id and text, ``labels`` with doc_id and quality; None without positives.

    Only rows that ``learn`` selects by their id are used, and of labels only the
    positive ones.  Rows with a null id or text are not learned from.
    """
    known = docs.where(learn & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    trusted = labels.where(learn & (F.col("quality") == 1)).select("doc_id")
    positives = sample_features(known, trusted, sample_rows)
    if not len(positives):
        return None
    return fit_arrays(positives, sample_features(known, known.select("doc_id"), sample_rows))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as one struct, with a score of 0 to 1, higher for better text.

    A null text counts as empty, and the empty text has a score like any other.
    Without a model every score is 0.5.  Equal texts score alike, repeated rows stay
    separate, empty tables give no rows, other columns cannot clash.
    """
    rows = packed(docs, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([text_features(t) for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()], float)
            known = sent.value
            scores = known.scores(raw) if known is not None and len(raw) else np.full(len(raw), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(scores, pa.float64())], [ROW, "score"])

    return rows.mapInArrow(judge, StructType([rows.schema[ROW], StructField("score", DoubleType())]))

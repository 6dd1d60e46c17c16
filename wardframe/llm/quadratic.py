"""Quality scores by a regularised quadratic discriminant over document statistics.

Every text gives a fixed vector of statistics, transformed to be roughly symmetric. Per class the
mean and the covariance are shrunk (towards the pooled covariance, then towards its diagonal); their
Cholesky factors are computed once and travel with the tasks. The score is the posterior of class 1:
the logistic of the log prior odds and the difference of the Gaussian log densities, each from a
Mahalanobis distance by a triangular solve.

The fit needs only sums of outer products, which Spark adds up over all labelled rows.

Defined results: NULL is the empty text and is scored like any other; rows with a NULL label, or
whose labels disagree, teach nothing; a label repeated with the same value counts once; if only one
class (or none) was learned every score is that class's value (0.5); an empty table gives an empty
table; extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.llm.texts import text_udf

#: Share of the pooled covariance in each class covariance, and of the diagonal in the result.
TOWARDS_POOLED = 0.1
TOWARDS_DIAGONAL = 0.02
THRESHOLD = 0.3
FEATURES = (
    "words", "word_length", "length_spread", "symbols", "exclamations", "bars", "capitals", "digits", "unlike_words",
    "top_word", "equal_neighbours", "repeated_triples", "repeated_lines", "sentences", "lines", "other_marks",
)
_CLASS = np.full(256, 0)
for _codes, _kind in (
    (b"#*$%&<>", 1), (b"!", 2), (b"|", 3), (bytes(range(65, 91)), 4), (bytes(range(97, 123)), 5), (b"0123456789", 6),
    (b".?", 7), (b"\n", 8), (b"\"'(),-/:;=@[]^_`{}~+\\", 9),
):
    _CLASS[list(_codes)] = _kind


def _rate(part: float, whole: float) -> float:
    """Square root of a share: small shares spread out, zero stays zero."""
    return float(np.sqrt(part / whole)) if whole > 0 else 0.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    kinds = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=10)
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), dtype=float, count=n)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = kinds[4] + kinds[5]
    return [
        np.log1p(n), np.log(lengths.mean()), np.log1p(lengths.std()), _rate(kinds[1], n), _rate(kinds[2], n),
        _rate(kinds[3], n), _rate(kinds[4], letters), _rate(kinds[6], raw.size),
        np.log1p(len(counts)) / np.log1p(n), _rate(max(counts.values()), n),
        _rate(sum(map(str.__eq__, words, words[1:])), n), _rate(max(n - 2, 0) - triples, n),
        _rate(len(lines) - len(set(lines)), len(lines)), _rate(kinds[7], n), _rate(kinds[8], n), _rate(kinds[9], n),
    ]


def _statistics_kernel():
    def run(texts: list) -> pd.DataFrame:
        return pd.DataFrame({"x": pd.Series([statistics(t) for t in texts], dtype=object)})

    return run


def statistics_column(text: str | Column = "text") -> Column:
    """Array of the statistics, one entry per name in ``FEATURES``."""
    return text_udf(_statistics_kernel, "x array<double>")(text)["x"]


@dataclass
class QuadraticModel:
    """Means and lower Cholesky factors of the covariances of class 0 and 1; None: one class only."""

    means: list[np.ndarray] | None
    factors: list[np.ndarray] | None
    log_odds: float
    shift: np.ndarray
    scale: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(rows), 1.0 / (1.0 + np.exp(-self.log_odds)))
        z = (rows - self.shift) / self.scale
        odds = np.full(len(rows), self.log_odds)
        for sign, mean, factor in zip((-1, 1), self.means, self.factors, strict=True):
            off = np.linalg.solve(factor, (z - mean).T)
            odds += sign * (-0.5 * (off * off).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        for label in (0, 1):
            own = batch.loc[batch["label"] == label, "x"]
            if len(own):
                x = np.stack(own.to_list()).astype(float)
                sums[label] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
    for label in (0, 1):
        if sums[label, 0]:
            yield pd.DataFrame({"label": label, "at": np.arange(sums.shape[1]), "v": sums[label]})


def clean_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row per id whose labels are all 0 or all 1."""
    both = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return both.where("low = high").select(key, F.col("low").cast("int").alias("label"))


def fit(labelled: DataFrame) -> QuadraticModel:
    """Model from rows of ``x`` (statistics) and ``label`` (0 or 1); only sums reach the driver."""
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    rows = labelled.select("label", "x").mapInPandas(_moments, "label int, at int, v double")
    for r in rows.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        sums[r["label"], r["at"]] = r["v"]
    n = sums[:, 0]
    if n.min() < 2:
        odds = 0.0 if n.sum() == 0 else (1 if n[1] > n[0] else -1) * np.log1p(n.sum())
        return QuadraticModel(None, None, float(odds), np.zeros(d), np.ones(d))
    means = sums[:, 1:1 + d] / n[:, None]
    seconds = sums[:, 1 + d:].reshape(2, d, d)
    total = n.sum()
    shift = (n[:, None] * means).sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(seconds.sum(axis=0)) / total - shift**2, 1e-6))
    covariances = [
        (seconds[c] / n[c] - np.outer(means[c], means[c])) / np.outer(scale, scale) for c in (0, 1)
    ]
    pooled = sum(n[c] * covariances[c] for c in (0, 1)) / total
    factors = []
    for own in covariances:
        mixed = (1 - TOWARDS_POOLED) * own + TOWARDS_POOLED * pooled
        mixed = (1 - TOWARDS_DIAGONAL) * mixed + TOWARDS_DIAGONAL * np.diag(np.diag(pooled) + 1e-3)
        factors.append(np.linalg.cholesky((mixed + mixed.T) / 2))
    return QuadraticModel([(m - shift) / scale for m in means], factors, float(np.log(n[1] / n[0])), shift, scale)


def score_statistics(model: QuadraticModel, column: str) -> Column:
    """Posterior of class 1 from a column of statistics."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.scores(np.stack(x.to_list()).astype(float)) if len(x) else [], dtype=float)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(column)


def score_texts(model: QuadraticModel, text: str | Column = "text") -> Column:
    """Posterior of class 1 from whole texts, in one pass."""

    def make():
        def run(texts: list) -> pd.DataFrame:
            rows = np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
            return pd.DataFrame({"score": model.scores(rows)})

        return run

    return text_udf(make, "score double")(text)["score"]

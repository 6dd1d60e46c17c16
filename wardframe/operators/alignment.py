"""Soft dynamic time warping of predicted against real series, and the DILATE score.

The recursion has no SQL form for series of any length, so it runs as an Arrow UDF: a
whole batch of equally long pairs advances together along the anti-diagonals. Series are
short (steps x features of one patient), so a batch fits easily in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, GAMMA = 0.3, 0.01
_BORDER = 1e10
#: Cells of the cost matrices of one slice.
_SLICE_CELLS = 256 * 64


def _diagonals(n: int, m: int):
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        yield i, d - i


def soft_alignment(cost: np.ndarray, gamma: float, with_path: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Soft-DTW value and expected alignment of a batch of cost matrices ``(b, n, m)``."""
    b, n, m = cost.shape
    total = np.full((b, n + 1, m + 1), _BORDER)
    total[:, 0, 0] = 0.0
    # share[..., s]: weight of the step into a cell from the left, the diagonal and above
    share = np.zeros((b, n + 2, m + 2, 3))
    for i, j in _diagonals(n, m):
        options = np.stack([total[:, i, j - 1], total[:, i - 1, j - 1], total[:, i - 1, j]], axis=-1)
        low = options.min(axis=-1, keepdims=True)
        weight = np.exp((low - options) / gamma)
        mass = weight.sum(axis=-1, keepdims=True)
        total[:, i, j] = cost[:, i - 1, j - 1] + low[..., 0] - gamma * np.log(mass[..., 0])
        share[:, i, j] = weight / mass
    if not with_path:
        return total[:, n, m], None
    path = np.zeros((b, n + 2, m + 2))
    path[:, n + 1, m + 1] = 1.0
    share[:, n + 1, m + 1] = 1.0
    for i, j in reversed(list(_diagonals(n, m))):
        path[:, i, j] = (
            share[:, i, j + 1, 0] * path[:, i, j + 1]
            + share[:, i + 1, j + 1, 1] * path[:, i + 1, j + 1]
            + share[:, i + 1, j, 2] * path[:, i + 1, j]
        )
    return total[:, n, m], path[:, 1 : n + 1, 1 : m + 1]


def _cost(real: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    return (real[:, :, None] - predicted[:, None, :]) ** 2


def _batches(real: pd.Series, predicted: pd.Series):
    """Row positions and stacked pairs, one slice of equally long pairs at a time."""
    sizes = pd.DataFrame({"n": real.map(len).to_numpy(), "m": predicted.map(len).to_numpy()})
    for (n, m), group in sizes.groupby(["n", "m"]):
        if n == 0 or m == 0:
            continue
        where = group.index.to_numpy()
        rows = max(1, _SLICE_CELLS // (n * m))
        for start in range(0, len(where), rows):
            at = where[start : start + rows]
            yield at, np.stack(real.to_numpy()[at]).astype(float), np.stack(predicted.to_numpy()[at]).astype(float)


def soft_dtw(real: Column, predicted: Column, gamma: float = GAMMA) -> Column:
    """Shape term only."""

    @F.pandas_udf("double")
    def score(y: pd.Series, p: pd.Series) -> pd.Series:
        out = np.full(len(y), np.nan)
        for at, a, b in _batches(y, p):
            out[at] = soft_alignment(_cost(a, b), gamma, with_path=False)[0]
        return pd.Series(out)

    return score(real, predicted)


def shape_and_time(real: Column, predicted: Column, gamma: float = GAMMA) -> Column:
    """Struct of the shape term and the temporal distortion ``sum(E (i-j)^2) / n^2``."""

    @F.pandas_udf("shape double, temporal double")
    def score(y: pd.Series, p: pd.Series) -> pd.DataFrame:
        shape, temporal = np.full(len(y), np.nan), np.full(len(y), np.nan)
        for at, a, b in _batches(y, p):
            value, path = soft_alignment(_cost(a, b), gamma)
            n, m = path.shape[1:]
            lag = (np.arange(n)[:, None] - np.arange(m)[None, :]) ** 2
            shape[at] = value
            temporal[at] = (path * lag).sum(axis=(1, 2)) / (n * m)
        return pd.DataFrame({"shape": shape, "temporal": temporal})

    return score(real, predicted)


def alignment_path(real: Column, predicted: Column, gamma: float = GAMMA) -> Column:
    """Expected alignment as an array of rows."""

    @F.pandas_udf("array<array<double>>")
    def path(y: pd.Series, p: pd.Series) -> pd.Series:
        out: list = [None] * len(y)
        for at, a, b in _batches(y, p):
            found = soft_alignment(_cost(a, b), gamma)[1]
            for row, matrix in zip(at, found):
                out[row] = [list(line) for line in matrix]
        return pd.Series(out)

    return path(real, predicted)


def path_rows(series: DataFrame, keys: list[str], gamma: float = GAMMA) -> DataFrame:
    """Long form ``(keys..., i, j, e)`` of the expected alignment."""
    lines = series.select(*keys, F.posexplode(alignment_path(F.col("real"), F.col("predicted"), gamma)).alias("i", "line"))
    return lines.select(*keys, (F.col("i") + 1).alias("i"), F.posexplode("line").alias("j", "e")).withColumn("j", F.col("j") + 1)


def squared_distances(series: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise squared distances of two short sequences of one patient, in the JVM."""
    y, p = F.posexplode("real").alias("i", "y"), F.posexplode("predicted").alias("j", "p")
    rows = series.select(*keys, "predicted", y).select(*keys, "i", "y", p)
    return rows.select(
        *keys, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"),
        ((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("distance"),
    )


def series_pairs(predictions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Real and predicted arrays per key from long predictions; cells that are masked or
    missing are dropped within the patient, so series never mix."""
    seen = predictions.filter(F.col("observed") & F.col("y").isNotNull() & F.col("yhat").isNotNull())
    packed = seen.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*order, "y", "yhat"))).alias("cells")
    )
    return packed.select(
        *keys,
        F.transform("cells", lambda c: c["y"]).alias("real"),
        F.transform("cells", lambda c: c["yhat"]).alias("predicted"),
    )


def dilate(series: DataFrame, alpha: float = ALPHA, gamma: float = GAMMA) -> DataFrame:
    """Adds ``shape``, ``temporal`` and ``dilate = alpha*shape + (1-alpha)*temporal``."""
    scored = series.withColumn("__s", shape_and_time(F.col("real"), F.col("predicted"), gamma))
    return scored.select(*series.columns, "__s.shape", "__s.temporal").withColumn(
        "dilate", alpha * F.col("shape") + (1 - alpha) * F.col("temporal")
    )

"""Forecast scores on long predictions ``(pid, step, feature, y, yhat, observed)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.operators.sampling import bootstrap_weights, cell_key
from wardframe.session import cut_lineage

MMD_BANDWIDTHS = (10, 15, 20, 50)


def _error() -> Column:
    return F.col("y") - F.col("yhat")


def masked_scores(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MSE, MAE and R2 over observed cells, in one aggregation."""
    e = _error()
    seen = predictions.filter(F.col("observed") & F.col("y").isNotNull() & F.col("yhat").isNotNull())
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count(F.lit(1)))).alias("r2"),
    )


def dimension_means(predictions: DataFrame) -> DataFrame:
    """Mean real and predicted value per (step, feature)."""
    return predictions.groupBy("step", "feature").agg(F.avg("y").alias("real"), F.avg("yhat").alias("predicted"))


def rmse_per_feature(predictions: DataFrame, digits: int = 2) -> DataFrame:
    """RMSE of each patient and feature, then mean and population deviation over patients."""
    e = _error()
    each = predictions.groupBy("pid", "feature").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return each.groupBy("feature").agg(
        F.count("rmse").alias("patients"),
        F.round(F.avg("rmse"), digits).alias("mean"),
        F.round(F.stddev_pop("rmse"), digits).alias("std"),
    )


def metric_summary(values: DataFrame, keys: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    """Mean and population deviation of a list of metric values."""
    return values.groupBy(*keys).agg(
        F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_pop(value), digits).alias("std")
    )


def batch_report(predictions: DataFrame, batches: DataFrame, digits: int = 3) -> DataFrame:
    """Scores per batch of patients, then mean and deviation over batches."""
    scored = masked_scores(predictions.join(batches, "pid"), ["batch"])
    long = scored.unpivot(["batch"], ["rmse", "mae", "r2"], "metric", "score")
    return metric_summary(long, ["metric"], "score", digits)


def real_and_predicted(predictions: DataFrame) -> DataFrame:
    """One row per value with its kind, for side-by-side distributions."""
    return predictions.select("pid", "step", "feature", F.col("y").alias("real"), F.col("yhat").alias("predicted")).unpivot(
        ["pid", "step", "feature"], ["real", "predicted"], "kind", "value"
    )


def prediction_interval(predictions: DataFrame, z: float = 1.96) -> DataFrame:
    """``yhat -/+ z * sqrt(SSE / (n - 2))`` per feature; the per-feature table is tiny."""
    e = _error()
    width = predictions.groupBy("feature").agg(
        (z * F.sqrt(F.try_divide(F.sum(e * e), F.count(e) - 2))).alias("__width")
    )
    return (
        predictions.join(F.broadcast(width), "feature")
        .withColumn("lower", F.col("yhat") - F.col("__width"))
        .withColumn("upper", F.col("yhat") + F.col("__width"))
        .drop("__width")
    )


def bootstrap_mse(
    predictions: DataFrame, features: Sequence[str], replicates: int = 10, quantiles: tuple[float, float] = (0.05, 0.95)
) -> DataFrame:
    """Mean, deviation and quantiles of the MSE over multinomial resamples, per feature."""
    usable = predictions.filter(_error().isNotNull())
    drawn = bootstrap_weights(usable, cell_key(features, 7), ("pid", "step"), ("feature",), replicates)
    e = _error()
    mse = drawn.groupBy("feature", "replicate").agg(
        (F.sum(e * e * F.col("times")) / F.sum("times")).alias("mse")
    )
    return mse.groupBy("feature").agg(
        F.avg("mse").alias("mean"),
        F.stddev_samp("mse").alias("std"),
        F.percentile("mse", F.lit(quantiles[0])).alias("q05"),
        F.percentile("mse", F.lit(quantiles[1])).alias("q95"),
    )


def series_terms(x: float, most: int = 128) -> int:
    """Terms of the exponential series at ``x`` until they fall below 1e-18 of its scale."""
    term, k = 1.0, 0
    while term > 1e-18 or k < 2:
        k += 1
        term *= x / k
        if k > most or term > 1e12:
            raise ValueError("values too large for the kernel series; scale them to about [-1, 1]")
    return k + 1


def scalar_mmd(
    predictions: DataFrame, keys: Sequence[str] = (), bandwidths: Sequence[int] = MMD_BANDWIDTHS
) -> DataFrame:
    """RBF maximum mean discrepancy between real and predicted scalars, without pairs.

    ``exp(-(x-y)^2/2a) = exp(-x^2/2a) exp(-y^2/2a) sum_k (xy/a)^k / k!``, so the mean over
    all pairs is a sum of products of moments; the work is linear in the rows instead of
    quadratic. The largest value decides how many terms double precision needs (few for
    values scaled to about [-1, 1]); values for which the series would lose its precision
    raise an error: scale them first.
    """
    def moment(x: Column, a: int, k: int) -> Column:
        return F.avg(F.pow(x, F.lit(k)) * F.exp(-x * x / (2 * a)))

    y, p = F.col("y"), F.col("yhat")
    used = predictions.filter(y.isNotNull() & p.isNotNull())
    largest = used.agg(F.max(F.greatest(F.abs(y), F.abs(p)))).first()[0] or 0.0
    terms = series_terms(largest * largest / min(bandwidths))
    moments = used.groupBy(*keys).agg(*[
        (moment(y, a, k) - moment(p, a, k)).alias(f"m{a}_{k}") for a in bandwidths for k in range(terms)
    ])
    total = F.lit(0.0)
    for a in bandwidths:
        weight = 1.0
        for k in range(terms):
            if k:
                weight /= a * k
            total = total + weight * F.col(f"m{a}_{k}") * F.col(f"m{a}_{k}")
    return moments.select(*keys, total.alias("mmd"))


#: Terms of the Hermite series; values lie within half a bandwidth of their cell's centre, so the rest is below 1e-14.
HERMITE_TERMS = 20
#: Cells further apart than this have a kernel below 1e-14.
NEAR_CELLS = 9


def _cell_pairs(terms: int):
    """Task function: moments of two cells and their distance in bandwidths to their part of the kernel sum."""
    import numpy as np
    import pandas as pd

    places = np.arange(terms)[:, None] + np.arange(terms)[None, :]
    signs = (-1.0) ** np.arange(terms)

    def run(batches):
        for batch in batches:
            x = batch["apart"].to_numpy(dtype=float) / np.sqrt(2.0)
            # Hermite functions h_n(x) = H_n(x) exp(-x^2), by their recurrence.
            h = np.zeros((len(batch), 2 * terms - 1))
            if len(batch):
                h[:, 0] = np.exp(-x * x)
                h[:, 1] = 2 * x * h[:, 0]
                for n in range(1, 2 * terms - 2):
                    h[:, n + 1] = 2 * x * h[:, n] - 2 * n * h[:, n - 1]
                left, right = np.stack(batch["left"].to_numpy()), np.stack(batch["right"].to_numpy()) * signs
                part = np.einsum("ni,nij,nj->n", left, h[:, places], right)
            else:
                part = np.zeros(0)
            yield pd.DataFrame({"part_of": batch["part_of"], "part": part})

    return run


def gauss_mmd(predictions: DataFrame, keys: Sequence[str] = (), bandwidths: Sequence[int] = MMD_BANDWIDTHS) -> DataFrame:
    """``scalar_mmd`` for values of any magnitude, by a fast Gauss transform.

    Values go to cells as wide as the kernel, and each cell keeps the moments of its signed weights
    (real 1/n, predicted -1/n) about its own centre; they combine before the shuffle. Two cells
    interact through the Hermite series of their distance, and only if they are near. The work
    is linear in the rows plus, per occupied cell, a fixed number of neighbours.
    """
    by = list(keys) or ["__all"]
    rows = predictions if keys else predictions.withColumn("__all", F.lit(0))
    used = cut_lineage(rows.filter(F.col("y").isNotNull() & F.col("yhat").isNotNull()).select(*by, "y", "yhat"))
    counts = used.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    signed = F.array(F.struct(F.col("y").cast("double").alias("v"), F.lit(1).alias("sign")), F.struct(F.col("yhat").cast("double").alias("v"), F.lit(-1).alias("sign")))
    widths = F.array(*[F.lit(float(a)) for a in bandwidths])
    points = used.select(*by, F.inline(signed)).select(*by, "v", "sign", F.explode(widths).alias("a"))
    cell = F.floor(F.col("v") / F.sqrt("a"))
    placed = points.withColumn("cell", cell).withColumn("u", (F.col("v") - (F.col("cell") + 0.5) * F.sqrt("a")) / F.sqrt(2 * F.col("a")))
    factorials = [math.factorial(k) for k in range(HERMITE_TERMS)]
    sums = [F.sum(F.col("sign") * F.pow("u", F.lit(k)) / factorials[k]) for k in range(HERMITE_TERMS)]
    cells = cut_lineage(placed.groupBy(*by, "a", "cell").agg(F.array(*sums).alias("moments")))
    offsets = F.explode(F.sequence(F.lit(-NEAR_CELLS), F.lit(NEAR_CELLS))).alias("apart")
    asked = cells.select(*by, "a", (F.col("cell")).alias("from_cell"), F.col("moments").alias("left"), offsets).withColumn("cell", F.col("from_cell") + F.col("apart"))
    pairs = asked.join(cells.withColumnRenamed("moments", "right"), [*by, "a", "cell"]).select(
        F.to_json(F.struct(*by)).alias("part_of"), F.col("apart").cast("double").alias("apart"), "left", "right"
    )
    parts = pairs.mapInPandas(_cell_pairs(HERMITE_TERMS), "part_of string, part double").groupBy("part_of").agg(F.sum("part").alias("total"))
    named = counts.withColumn("part_of", F.to_json(F.struct(*by)))
    return named.join(parts, "part_of").select(*keys, (F.col("total") / F.col("n") / F.col("n")).alias("mmd"))


def vector_mmd(vectors: DataFrame, bandwidths: Sequence[int] = MMD_BANDWIDTHS) -> DataFrame:
    """RBF discrepancy of patient vectors per batch; ``(batch, real array, predicted array)``
    with one row per patient. Batches have a fixed small size, so a batch is one group."""
    import numpy as np
    import pandas as pd

    def distance(a, b):
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)

    def kernel(a, b):
        d = distance(a, b)
        return sum(np.exp(-0.5 * d / width) for width in bandwidths)

    def score(key, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(rows["predicted"].to_numpy()), np.stack(rows["real"].to_numpy())
        value = float(np.mean(kernel(x, x) + kernel(y, y) - 2 * kernel(x, y)))
        return pd.DataFrame({"batch": [key[0]], "patients": [len(rows)], "mmd": [value]})

    return vectors.groupBy("batch").applyInPandas(score, "batch long, patients long, mmd double")


def gaussian_kl(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """KL of N(mu, exp(logvar)) to N(0, 1) and summed squared reconstruction error."""
    mu, logvar = F.col("mu"), F.col("logvar")
    kl = -0.5 * F.sum(1 + logvar - mu * mu - F.exp(logvar))
    e = _error()
    return rows.groupBy(*keys).agg(kl.alias("kl"), F.sum(e * e).alias("sse")).withColumn(
        "loss", F.col("kl") + F.col("sse")
    )


def dice_bce(rows: DataFrame, keys: Sequence[str] = (), smooth: float = 1.0) -> DataFrame:
    """Binary cross-entropy plus Dice loss of probabilities ``yhat`` against labels ``y``."""
    y, p = F.col("y"), F.col("yhat")

    def log(x: Column) -> Column:
        return F.greatest(F.when(x > 0, F.log(x)).otherwise(F.lit(-100.0)), F.lit(-100.0))

    return rows.groupBy(*keys).agg(
        F.avg(-(y * log(p) + (1 - y) * log(1 - p))).alias("bce"),
        (1 - (2 * F.sum(y * p) + smooth) / (F.sum(y) + F.sum(p) + smooth)).alias("dice"),
    ).withColumn("loss", F.col("bce") + F.col("dice"))

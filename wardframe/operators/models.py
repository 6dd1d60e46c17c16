"""Forecast and outcome models on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.functions.ranks import exact_rank, hash_key
from wardframe.operators import boosting
from wardframe.operators.classify import balanced_weights, curve_areas, curve_points, report
from wardframe.operators.relations import union_all
from wardframe.operators.sampling import assign_folds, stratified_split
from wardframe.session import cut_lineage

SEED = 422
LEARNING_RATE = 0.003
#: Weight of the squared coefficients (of standardised inputs) in the linear forecaster.
RIDGE = 1e-4
#: The defaults of the booster library.
TREES, DEPTH = 20, 5


def forecast_rows(examples: DataFrame, features: Sequence[str], n_in: int = 6, n_out: int = 6) -> DataFrame:
    """Long form: one row per (patient, feature, target step) with the feature's own
    history, its position and the static conditions; one global model serves all."""
    width = len(features)
    cells = F.array(*[
        F.struct(
            F.lit(n_in + s + 1).alias("step"), F.lit(f).alias("feature"),
            F.col("target")[s * width + j].alias("y"), F.col("target_mask")[s * width + j].alias("observed"),
            *[F.col("past")[t * width + j].alias(f"lag_{n_in - t}") for t in range(n_in)],
        )
        for s in range(n_out)
        for j, f in enumerate(features)
    ])
    rows = examples.select("pid", "conditions", F.inline(cells))
    flags = [(F.col("feature") == f).cast("double").alias(f"is_{j}") for j, f in enumerate(features[1:], 1)]
    return rows.select("*", F.col("step").cast("double").alias("horizon"), *flags)


def _inputs(features: Sequence[str], n_in: int, conditions: int) -> list[str]:
    static = [f"condition_{i}" for i in range(conditions)]
    return [*[f"lag_{i + 1}" for i in range(n_in)], "horizon", *[f"is_{j}" for j in range(1, len(features))], *static]


def _assembled(rows: DataFrame, features: Sequence[str], n_in: int, conditions: int) -> DataFrame:
    flat = rows.select(
        "*", *[F.col("conditions")[i].alias(f"condition_{i}") for i in range(conditions)]
    )
    return VectorAssembler(
        inputCols=_inputs(features, n_in, conditions), outputCol="inputs", handleInvalid="skip"
    ).transform(flat)


def fit_forecaster(rows: DataFrame, features: Sequence[str], n_in: int = 6, conditions: int = 10):
    """Global linear model fitted on observed targets."""
    train = rows.filter(F.col("observed") & F.col("y").isNotNull())
    model = LinearRegression(featuresCol="inputs", labelCol="y", predictionCol="yhat", regParam=RIDGE, solver="normal")
    return model.fit(_assembled(train, features, n_in, conditions))


def forecast(model, rows: DataFrame, features: Sequence[str], n_in: int = 6, conditions: int = 10) -> DataFrame:
    """Batch scoring: ``(pid, step, feature, y, yhat, observed)``."""
    scored = model.transform(_assembled(rows, features, n_in, conditions))
    return scored.select("pid", "step", "feature", "y", "yhat", "observed")


def _fold_moments(slots: int, k: int):
    """Sums of products of (1, inputs, target) per repeat and fold, added up within a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            z = np.column_stack([np.ones(len(batch)), np.stack(batch["x"].to_numpy()), batch["y"].to_numpy()])
            folds = np.stack(batch["folds"].to_numpy())
            for repeat in range(slots):
                for fold in range(k):
                    own = z[folds[:, repeat] == fold]
                    sums[repeat, fold] = sums.get((repeat, fold), 0.0) + own.T @ own
        rows = [(repeat, fold, moments.ravel()) for (repeat, fold), moments in sums.items()]
        yield pd.DataFrame(rows, columns=["repeat", "fold", "moments"])

    return run


def ridge_coefficients(moments: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from the sums of products of (1, inputs, target): the minimum that
    ``LinearRegression`` finds, which penalises standardised inputs. Constant inputs get zero."""
    mean = moments[0] / moments[0, 0]
    spread = moments / moments[0, 0] - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(spread), 0.0))
    moving = sd > 1e-12 * np.maximum(1.0, np.abs(mean))
    used = np.flatnonzero(moving[1:-1]) + 1
    weights = np.zeros(len(mean) - 2)
    if moving[-1] and len(used):
        scaled = spread[np.ix_(used, used)] / np.outer(sd[used], sd[used])
        toward = spread[used, -1] / (sd[used] * sd[-1])
        solved = np.linalg.lstsq(scaled + np.eye(len(used)) * (ridge / sd[-1]), toward, rcond=None)[0]
        weights[used - 1] = solved * sd[-1] / sd[used]
    return weights, float(mean[-1] - weights @ mean[1:-1])


def fold_ensemble(
    train_rows: DataFrame, test_rows: DataFrame, features: Sequence[str], k: int = 5, repeats: int = 10, conditions: int = 10, n_in: int = 6
) -> DataFrame:
    """One model per fold of every repeat, fitted without its fold; test predictions are the
    mean over all models, which for linear models is one model of the mean coefficients.

    One pass gives the sums of products of every fold; a model's sums are those of its repeat less
    those of its fold. Only these sums (repeats x folds x inputs squared numbers) reach the driver.
    Without observed training rows the prediction is NULL; a model whose training part is empty
    (all patients in one fold) is left out of the mean.
    """
    folds = assign_folds(train_rows, k, repeats).groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct("repeat", "fold")))["fold"].alias("folds")
    )
    seen = _assembled(train_rows.filter(F.col("observed") & F.col("y").isNotNull()), features, n_in, conditions)
    cells = seen.join(folds, "pid").select(vector_to_array("inputs").alias("x"), "y", "folds")
    partial = cells.mapInPandas(_fold_moments(repeats, k), "repeat int, fold int, moments array<double>")
    sums = partial.select("repeat", "fold", F.posexplode("moments").alias("cell", "v")).groupBy("repeat", "fold", "cell").agg(F.sum("v").alias("v"))
    width = len(_inputs(features, n_in, conditions)) + 2
    moments = np.zeros((repeats, k, width * width))
    for row in sums.collect():
        moments[row["repeat"], row["fold"], row["cell"]] = row["v"]
    without = (moments.sum(axis=1, keepdims=True) - moments).reshape(-1, width, width)
    fitted = [ridge_coefficients(m) for m in without if m[0, 0] > 0.5]
    rows = _assembled(test_rows, features, n_in, conditions)
    if not fitted:
        return rows.select("pid", "step", "feature", "y", F.lit(None).cast("double").alias("yhat"), "observed")
    weights = F.array(*[F.lit(float(w)) for w in sum(w for w, _ in fitted) / len(fitted)])
    products = F.zip_with(vector_to_array("inputs"), weights, lambda x, w: x * w)
    yhat = F.aggregate(products, F.lit(sum(b for _, b in fitted) / len(fitted)), lambda s, x: s + x)
    return rows.select("pid", "step", "feature", "y", yhat.alias("yhat"), "observed")


def _vectors(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="inputs", handleInvalid="skip").transform(rows)


def fit_mortality(rows: DataFrame, inputs: Sequence[str], trees: int = TREES, depth: int = DEPTH) -> GBTClassificationModel:
    """Class-weighted boosted trees on flattened series; ``rows`` has ``label`` 0/1."""
    weighted = balanced_weights(rows)
    booster = GBTClassifier(
        featuresCol="inputs", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth,
        stepSize=LEARNING_RATE, seed=SEED,
    )
    return booster.fit(_vectors(weighted, inputs))


def score_mortality(model: GBTClassificationModel, rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return _scored(model, _vectors(rows, inputs))


def _scored(model: GBTClassificationModel, vectors: DataFrame) -> DataFrame:
    scored = model.transform(vectors)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("inputs", "rawPrediction", "probability")


def protocol_matrix(
    real: DataFrame, synthetic: DataFrame, inputs: Sequence[str], trees: int = TREES, depth: int = DEPTH
) -> DataFrame:
    """Train and test on real or predicted series: TRTR, TSTS, TRTS, TSTR.

    Both tables are ``(pid, label, inputs...)``; the split is by patient, so the two test
    sets hold the same patients.
    """
    parts = {}
    for name, rows in (("R", real), ("S", synthetic)):
        split = stratified_split(rows, "pid", "label")
        parts[name] = (split.filter(F.col("subset") == "train"), split.filter(F.col("subset") == "test"))
    models = {name: fit_mortality(train, inputs, trees, depth) for name, (train, _) in parts.items()}
    scored = [
        score_mortality(models[fit], parts[test][1], inputs)
        .select("label", "score", F.lit(f"T{fit}T{test}").alias("protocol"))
        for fit, test in (("R", "R"), ("S", "S"), ("R", "S"), ("S", "R"))
    ]
    return report(reduce(lambda a, b: a.unionByName(b), scored), ["protocol"])


def newton_protocols(
    real: DataFrame, synthetic: DataFrame, inputs: Sequence[str], keys: Sequence[str] = (), rounds: int = boosting.ROUNDS,
    depth: int = boosting.DEPTH, rate: float = LEARNING_RATE,
) -> DataFrame:
    """The protocol matrix by Newton-boosted trees, for each value of ``keys`` (a cohort, say) by itself.

    The models of all keys and both tables grow in the same passes; all tests are scored in one.
    """
    group = F.concat_ws("/", *keys, F.lit("")) if keys else F.lit("")
    parts = {}
    for name, rows in (("R", real), ("S", synthetic)):
        stratum = F.concat_ws("/", *keys, F.col("label").cast("string"))
        own = rows.select(*keys, "pid", "label", *inputs).withColumn("stratum", stratum)
        parts[name] = cut_lineage(stratified_split(own, "pid", "stratum").drop("stratum"))
    train = [rows.filter(F.col("subset") == "train").withColumn("model", F.concat(group, F.lit(name))) for name, rows in parts.items()]
    boosters = boosting.fit_boosters(union_all(*train), inputs, rounds, depth, rate)
    tests = [
        parts[test].filter(F.col("subset") == "test").withColumns({"model": F.concat(group, F.lit(fit)), "protocol": F.lit(f"T{fit}T{test}")})
        for fit in "RS" for test in "RS"
    ]
    scored = boosting.score_models(boosters, union_all(*tests)).select(*keys, "protocol", "label", "score")
    return report(cut_lineage(scored), [*keys, "protocol"])


def permutation_importance(
    model: GBTClassificationModel, rows: DataFrame, inputs: Sequence[str], groups: dict[str, Sequence[str]], seed: int = 7
) -> DataFrame:
    """Loss of AUC when all columns of one feature are taken from another patient.

    ``rows`` should be held out from the fit. The other patient is found by one equi-join of two
    hash ranks, which is a permutation; all variants are then made from the joined row in one pass.
    """
    values = F.array(*[F.col(c).cast("double") for c in inputs])
    own = cut_lineage(rows.dropna(subset=list(inputs)).select("pid", "label", values.alias("own")))
    takers = exact_rank(own.withColumn("__k", hash_key(F.col("pid"), seed)), "__k", ("pid",), rank="__r", total=None)
    donors = exact_rank(own.withColumn("__k", hash_key(F.col("pid"), seed + 1)), "__k", ("pid",), rank="__r", total=None)
    both = takers.join(donors.select("__r", F.col("own").alias("other")), "__r")

    def variant(name: str, columns: Sequence[str]) -> Column:
        mixed = F.array(*[F.col("other" if c in columns else "own")[i] for i, c in enumerate(inputs)])
        return F.struct(F.lit(name).alias("shuffled"), mixed.alias("x"))

    variants = [variant("(none)", ()), *[variant(name, columns) for name, columns in groups.items()]]
    rows = both.select("label", F.inline(F.array(*variants)))
    scored = _scored(model, rows.select("label", "shuffled", array_to_vector("x").alias("inputs")))
    areas = curve_areas(curve_points(scored.select("label", "score", "shuffled"), ["shuffled"]), ["shuffled"])
    base = F.max(F.when(F.col("shuffled") == "(none)", F.col("auc"))).over(Window.partitionBy())  # one row per feature
    return areas.select(F.col("shuffled").alias("feature"), (base - F.col("auc")).alias("auc_loss")).filter(
        F.col("feature") != "(none)"
    )


def grouped_importance(model: GBTClassificationModel, inputs: Sequence[str], groups: dict[str, Sequence[str]]) -> list[tuple[str, float]]:
    """Split-gain importance of the fitted trees, summed over the steps of each feature."""
    gains = dict(zip(inputs, model.featureImportances.toArray()))
    return [(name, float(sum(gains[c] for c in columns))) for name, columns in groups.items()]

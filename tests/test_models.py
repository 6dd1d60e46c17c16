"""Queries without SQL: models, clipped regression, masked alignment, on small fixtures."""

import numpy as np
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from wardframe.operators import alignment, metrics, models, regression_impute, sampling
from wardframe.sources import writers

FEATURES = ("a", "b")


def examples(spark, n=40):
    """Targets equal the last history value of their feature."""
    rng = np.random.default_rng(3)
    rows = []
    for pid in range(n):
        past = [float(v) for v in rng.random(12)]
        rows.append((pid, past, past[10:12] * 6, [True] * 12, [float(v) for v in rng.random(10)]))
    schema = "pid long, past array<double>, target array<double>, target_mask array<boolean>, conditions array<double>"
    return models.forecast_rows(spark.createDataFrame(rows, schema), FEATURES)


def test_forecaster_and_ensemble_learn_persistence(spark):
    rows = examples(spark)
    train, test = rows.filter("pid < 30"), rows.filter("pid >= 30")
    single = models.forecast(models.fit_forecaster(train, FEATURES), test, FEATURES)
    both = models.fold_ensemble(train, test, FEATURES, k=2)
    for predicted in (single, both):
        score = metrics.masked_scores(predicted).first()
        assert score.cells == 120 and score.rmse < 0.01


def test_ensemble_is_the_mean_of_models_fitted_one_by_one(spark):
    rows = examples(spark).withColumn("y", F.col("y") + F.rand(5) * F.col("lag_2"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    train, test = rows.filter("pid < 30"), rows.filter("pid >= 30")
    folds = sampling.assign_folds(train, 3, 2).collect()
    each = []
    for repeat in (1, 2):
        for fold in range(3):
            inside = [r.pid for r in folds if r.repeat == repeat and r.fold != fold]
            model = models.fit_forecaster(train.filter(F.col("pid").isin(inside)), FEATURES)
            scored = models.forecast(model, test, FEATURES).orderBy("pid", "feature", "step").collect()
            each.append([r.yhat for r in scored])
    got = models.fold_ensemble(train, test, FEATURES, k=3, repeats=2).orderBy("pid", "feature", "step").collect()
    assert np.allclose([r.yhat for r in got], np.mean(each, axis=0), atol=1e-8)


def test_ensemble_without_training_rows_predicts_nothing(spark):
    rows = examples(spark, 5)
    got = models.fold_ensemble(rows.filter("false"), rows, FEATURES, k=2, repeats=2).collect()
    assert len(got) == 60 and all(r.yhat is None for r in got)


def test_saved_model_predicts_the_same(spark, tmp_path):
    rows = examples(spark, 12)
    model = models.fit_forecaster(rows, FEATURES)
    writers.save_model(model, f"{tmp_path}/model")
    back = LinearRegressionModel.load(f"{tmp_path}/model")
    one, two = (models.forecast(m, rows, FEATURES).orderBy("pid", "feature", "step").collect() for m in (model, back))
    assert len(one) == 144 and one == two


def test_constant_inputs_get_no_weight():
    x = np.column_stack([np.ones(8), np.full(8, 0.3), np.arange(8.0), np.arange(8.0) * 2 + 1])
    weights, intercept = models.ridge_coefficients(x.T @ x, 0.0)
    assert weights[0] == 0 and abs(weights[1] - 2) < 1e-9 and abs(intercept - 1) < 1e-9


def test_protocols_and_importance_on_separable_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(i % 2), float(i % 2) + float(rng.random()) / 4, float(rng.random())) for i in range(80)]
    df = spark.createDataFrame(rows, "pid long, label double, x_1 double, n_1 double")
    got = {r.protocol: r for r in models.protocol_matrix(df, df, ["x_1", "n_1"], trees=2, depth=2).collect()}
    assert set(got) == {"TRTR", "TSTS", "TRTS", "TSTR"}
    assert all(r.accuracy == 1.0 and r.auc == 1.0 for r in got.values())
    model = models.fit_mortality(df, ["x_1", "n_1"], trees=2, depth=2)
    loss = models.permutation_importance(model, df, ["x_1", "n_1"], {"x": ["x_1"], "n": ["n_1"]})
    loss = {r.feature: r.auc_loss for r in loss.collect()}
    assert loss["x"] > 0.2 and abs(loss["n"]) < 1e-9


def test_iterative_imputation_is_clipped(spark):
    rows = [(i, i / 10.0, 2.0 * i / 10.0 if i < 4 else None) for i in range(10)]
    got = regression_impute.fill_iterative(spark.createDataFrame(rows, "pid long, a double, b double"), ("a", "b"), 3, 0.0)
    assert [round(r.b, 6) for r in got.orderBy("pid").collect()] == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.0, 1.0, 1.0, 1.0]


def test_masked_cells_leave_the_series(spark):
    rows = [(1, 7, 0.1, 0.2, True), (1, 8, 0.9, 0.0, False), (1, 9, 0.3, 0.3, True)]
    df = spark.createDataFrame(rows, "pid long, step int, y double, yhat double, observed boolean")
    row = alignment.dilate(alignment.series_pairs(df, ["pid"], ["step"])).first()
    assert (row.real, row.predicted) == ([0.1, 0.3], [0.2, 0.3])
    shape, path = alignment.soft_alignment(alignment._cost(np.array([row.real]), np.array([row.predicted])), alignment.GAMMA)
    assert abs(row.shape - shape[0]) < 1e-12
    assert abs(row.temporal - (path[0, 0, 1] + path[0, 1, 0]) / 4) < 1e-12
    assert df.filter(F.col("observed")).count() == 2

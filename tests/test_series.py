"""Closed-form and brute-force checks of series operators."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from wardframe.functions.ranks import exact_rank, hash_key
from wardframe.operators import alignment, classify, events, impute, knn_impute, metrics, regression_impute, relations, sampling
from wardframe.operators import labs, reports, windows
from wardframe.sources import readers, writers
from wardframe.sources.schemas import TABLES
from wardframe.streaming import charted

FEATURES = ("a", "b", "c")


def random_cells(spark, n=60, share=0.35):
    rng = np.random.default_rng(5)
    rows = [
        (p, s, f, None if rng.random() < share else float(np.round(rng.random(), 2)))
        for p in range(n // 6) for s in range(1, 7) for f in FEATURES
    ]
    return spark.createDataFrame(rows, "pid long, step int, feature string, value double"), rows


def test_exact_rank_is_a_permutation(spark):
    df = spark.range(500).withColumn("k", hash_key(F.col("id"), 3))
    got = [r.rank for r in exact_rank(df, "k", ("id",), buckets=7).orderBy("k", "id").collect()]
    assert got == list(range(1, 501))


def test_knn_equals_brute_force(spark):
    df, rows = random_cells(spark)
    got = {(r.pid, r.step, r.feature): r.imputed for r in knn_impute.fill_knn(df, FEATURES, bins=4, chunk_rows=5).collect()}
    table = {}
    for p, s, f, v in rows:
        table.setdefault((p, s), {})[f] = np.nan if v is None else v
    keys = sorted(table)
    x = np.array([[table[k][f] for f in FEATURES] for k in keys])
    for i, key in enumerate(keys):
        for t, f in enumerate(FEATURES):
            if not np.isnan(x[i, t]):
                assert got[(*key, f)] == x[i, t]
                continue
            both = ~np.isnan(x) & ~np.isnan(x[i])
            ok = np.flatnonzero(both.any(axis=1) & ~np.isnan(x[:, t]))
            if not len(ok):
                want = np.nanmean(x[:, t])
            else:
                d2 = np.round(np.where(both, (x - x[i]) ** 2, 0).sum(1)[ok] * 3 / both.sum(1)[ok], 12)
                near = ok[np.lexsort((ok, d2))][:5]
                d, v = np.sort(d2)[:5], x[near, t]
                want = v[d == 0].mean() if (d == 0).any() else (v / np.sqrt(d)).sum() / (1 / np.sqrt(d)).sum()
            assert abs(got[(*key, f)] - want) < 1e-9


def test_imputers_keep_observed_cells(spark):
    df, _ = random_cells(spark)
    for fill in impute.column_methods(FEATURES).values():
        assert fill(df, ()).filter(F.col("value").isNotNull() & (F.col("value") != F.col("imputed"))).count() == 0


def test_amputation_hides_the_right_number(spark):
    df, _ = random_cells(spark)
    got = sampling.amputate(df, FEATURES, 20).groupBy("feature").agg(
        F.count("truth").alias("n"), F.sum(F.col("masked").cast("int")).alias("m")
    )
    assert all(r.m == round(r.n * 0.2) for r in got.collect())


def test_chained_regression_recovers_a_line(spark):
    rows = [(i, float(i), 2.0 * i + 1 if i % 3 else None) for i in range(30)]
    wide = spark.createDataFrame(rows, "pid long, a double, b double")
    got = regression_impute.fill_mice(wide, ("a", "b")).collect()
    assert all(abs(r.b - (2 * r.a + 1)) < 1e-6 for r in got)


def test_bootstrap_draws_as_many_as_rows(spark):
    df = spark.range(40).select(F.lit("f").alias("g"), "id")
    drawn = sampling.bootstrap_weights(df, hash_key(F.col("id")), ("id",), ("g",), 3)
    assert {r[1] for r in drawn.groupBy("replicate").agg(F.sum("times")).collect()} == {40}


def test_soft_dtw_tends_to_dtw_and_path_mass():
    x, y = np.array([[1.0, 2, 3, 3]]), np.array([[1.0, 1, 2, 3]])
    value, path = alignment.soft_alignment(alignment._cost(x, y), 1e-6)
    assert abs(value[0]) < 1e-3
    assert np.all(path >= 0) and abs(path[0, 0, 0] - 1) < 1e-9 and abs(path[0, -1, -1] - 1) < 1e-9


def test_scalar_mmd_equals_pairs(spark):
    rng = np.random.default_rng(1)
    y, p = rng.uniform(-1, 1, 40), rng.uniform(-1, 1, 40)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y double, yhat double")

    def k(a, b):
        d = (a[:, None] - b[None, :]) ** 2
        return sum(np.exp(-0.5 * d / w) for w in metrics.MMD_BANDWIDTHS)

    want = np.mean(k(y, y) + k(p, p) - 2 * k(y, p))
    assert abs(metrics.scalar_mmd(df).first().mmd - want) < 1e-12


def test_auc_counts_pairs(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    pairs = [(a > b) + 0.5 * (a == b) for la, a in rows for lb, b in rows if la == 1 and lb == 0]
    assert math.isclose(classify.curve_areas(classify.curve_points(df)).first().auc, sum(pairs) / len(pairs))


def test_box_statistics_one_value(spark):
    df = spark.createDataFrame([("x", 2.0)] * 9, "k string, v double")
    row = reports.box_statistics(df, ["k"], "v").first()
    assert (row.n, row.low, row.median, row.high) == (9, 2.0, 2.0, 2.0)


def test_edge_pad_repeats_the_first_row(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0)], "pid long, t int, v double")
    got = windows.edge_pad(df, ["t"], 4).orderBy("step").collect()
    assert [(r.step, r.v) for r in got] == [(1, 5.0), (2, 5.0), (3, 5.0), (4, 6.0)]


def test_first_lab_keeps_empty_stays_and_null_over_limit(spark):
    t = datetime.datetime(2100, 1, 1, 10)
    stays = spark.createDataFrame(
        [(1, 1, 1, None, None, None, None, None, t, t, 1.0), (2, 2, 2, None, None, None, None, None, t, t, 1.0)], TABLES["icustays"]
    )
    readings = [(1, 1, 50862, t, None, 99.0, None), (1, 1, 50862, t + datetime.timedelta(hours=1), None, 4.0, None),
                (1, 1, 50912, t, None, 1.5, None), (1, 1, 50912, t, None, 2.5, None)]
    lab = spark.createDataFrame(readings, TABLES["labevents"])
    adm = spark.createDataFrame([], TABLES["admissions"])
    got = {r.icustay_id: r for r in labs.first_day_labs(stays, lab, adm).collect()}
    assert got[1].ALBUMIN_1st is None and got[1].CREATININE_1st == 2.5 and got[2].CREATININE_1st is None


def test_update_insert(spark):
    df = spark.createDataFrame([(24, 1.0), (25, 2.0)], "id int, v double")
    changed = relations.insert_rows(relations.update_where(df, F.col("id") == 24, v=100.0), [(24, 200.0)])
    assert relations.union_distinct(df, changed).count() == 4


def test_series_csv_and_stream(spark, tmp_path):
    path = str(tmp_path / "series")
    spark.createDataFrame([(0, 7, 1.5, float("nan"))], "i long, pid long, a double, b double").write.option("header", True).csv(path)
    row = readers.read_series(spark, path, ("a", "b")).first()
    assert (row.pid, row.a, row.b) == (7, 1.5, None)
    t = datetime.datetime(2100, 1, 1)
    raw = spark.createDataFrame([(1, 1, 1, 678, t, t, "x", 98.6, "Deg. F", 0, None, None, None)], TABLES["chartevents"])
    writers.export_parquet(raw, str(tmp_path / "in"))
    stream = charted.chart_stream(spark, str(tmp_path / "in"))
    charted.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).collect() == events.chart_events(raw, None).collect()


def test_timed_grid_has_all_eight_methods(spark):
    from wardframe.plans import series

    rng = np.random.default_rng(3)
    rows = [(p, t, f, float(rng.random())) for p in range(6) for t in range(1, 4) for f in series.FEATURES]
    cells = spark.createDataFrame(rows, "pid long, step int, feature string, value double")
    log = impute.timed_grid(sampling.experiment_cells(cells, series.FEATURES, 1, (20,)), series.all_methods(), [0], [20]).collect()
    print({r.method: (round(r.rmse, 3), round(r.seconds, 2)) for r in log})
    assert {r.method for r in log} == {
        "simple", "interpolate_linear", "random", "expectation_maximization", "moving_window", "knn", "iterative", "mice"
    }
    assert len(log) == 8 and len({r.cells for r in log}) == 1 and all(r.seconds > 0 and r.rmse < 2 for r in log)

"""Work units stay bounded: value buckets follow the data, distance matrices have a fixed size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardframe.functions.ranks import value_buckets
from wardframe.operators import classify, knn_impute, reports


def test_far_outlier_and_narrow_scores_do_not_fill_one_bucket(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") == 7, 1e12).otherwise(F.col("id").cast("double")).alias("wide"),
        (0.495 + F.col("id") / 2_000_000).alias("narrow"), (F.col("id") % 2).alias("g"),
    )
    for column, keys in (("wide", ["g"]), ("narrow", [])):
        sizes = value_buckets(rows, keys, column).groupBy(*keys, "__bucket").count()
        top, mean = sizes.agg(F.max("count"), F.avg("count")).first()
        assert top < 3 * mean


def test_buckets_rise_with_the_value_and_keep_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, v) for v in (None, -3.0, -3.0, 0.0, 2.5, 9.0)] + [(2, None)], "k int, v double")
    found = value_buckets(rows, ["k"], "v").filter("k = 1").orderBy("v").collect()
    places = [r["__bucket"] for r in found]
    assert places == sorted(places) and places[1] == places[2] and places[0] == 0
    assert value_buckets(rows, ["k"], "v").count() == 7
    assert value_buckets(rows.limit(0), ["k"], "v").count() == 0


def test_quartiles_with_an_outlier(spark):
    values = [1.0, 2.0, 3.0, 4.0, 1e9]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    row = reports.box_statistics(df, ["k"], "v").first()
    assert (row.low, row.q1, row.median, row.q3, row.high) == (1.0, 2.0, 3.0, 4.0, 1e9)


def test_curve_of_scores_that_lie_close_together(spark):
    rng = np.random.default_rng(6)
    score = 0.5 + rng.integers(0, 50, 400) / 1e5
    label = rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")
    areas = classify.curve_areas(classify.curve_points(df)).first()
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert areas.auc == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("rows", [300, 3000])
def test_neighbours_by_slices_equal_brute_force(monkeypatch, rows):
    monkeypatch.setattr(knn_impute, "DONOR_SLICE", 64)
    largest = []
    zeros = np.zeros
    monkeypatch.setattr(knn_impute.np, "zeros", lambda shape, *a, **k: largest.append(np.prod(shape)) or zeros(shape, *a, **k))
    rng = np.random.default_rng(rows)
    y = np.round(rng.random((rows, 3)), 1)  # many ties
    x = np.round(rng.random((20, 3)), 1)
    x[::2, 1] = np.nan
    ids = np.column_stack([rng.permutation(rows), np.ones(rows, dtype=int)])
    r, c, d2 = knn_impute._nearest_in_slices(x, y, [0, 1, 2], ids, 5)
    assert max(largest) <= 20 * 64
    for i in range(20):
        known = ~np.isnan(x[i])
        d = np.round(((x[i, known] - y[:, known]) ** 2).sum(axis=1) * 3 / known.sum(), 12)
        want = np.lexsort((ids[:, 0], d))[:5]
        assert np.allclose(d2[r == i], d[want]) and list(ids[c[r == i], 0]) == list(ids[want, 0])

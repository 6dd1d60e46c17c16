"""Whiskers, bootstrap bands, dropping relations, tables by name, protocols of several cohorts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardframe.operators import models, reports
from wardframe.sources import writers


def test_whiskers_end_at_data_within_reach(spark):
    rng = np.random.default_rng(0)
    groups = {"x": [*rng.normal(size=50), 9.0, -30.0, 9.5], "y": [1.0] * 5, "z": [1.0, 2.0, 100.0]}
    df = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values] + [("y", None)], "k string, v double")
    for r in reports.box_whiskers(df, ["k"], "v").collect():
        v = np.array(groups[r.k])
        q1, q3 = np.quantile(v, [0.25, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r.whisker_low, r.whisker_high, r.beyond, r.n) == (inside.min(), inside.max(), len(v) - len(inside), len(v))
    assert reports.box_whiskers(df.limit(0), ["k"], "v").count() == 0


def test_bootstrap_band_tends_to_the_normal_band(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(3, 2, 200)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)] + [("b", 0, 5.0), ("b", 1, None)], "k string, i int, v double")
    got = {r.k: r for r in reports.bootstrap_band(df, ["k"], "v", ["i"], 400).collect()}
    half = 1.96 * values.std() / np.sqrt(200)
    assert got["a"].n == 200 and abs(got["a"].mean - values.mean()) < 1e-9
    assert abs(got["a"].band_low - (values.mean() - half)) < 0.08 and abs(got["a"].band_high - (values.mean() + half)) < 0.08
    assert (got["b"].n, got["b"].band_low, got["b"].band_high) == (1, 5.0, 5.0)


def test_drop_refuses_or_cascades(spark):
    writers.publish(spark.range(5), "t_base")
    writers.publish(spark.sql("SELECT id + 1 AS id FROM t_base"), "t_middle")
    writers.publish(spark.sql("SELECT a.id FROM t_middle a WHERE a.id IN (SELECT id FROM t_base)"), "t_top")
    writers.publish(spark.range(3), "t_other")
    assert writers.dependants(spark, "t_base") == ["t_top", "t_middle"] and writers.dependants(spark, "t_other") == []
    with pytest.raises(ValueError):
        writers.drop_relation(spark, "t_middle")
    assert spark.table("t_top").count() == 4
    assert writers.drop_relation(spark, "t_base", cascade=True) == ["t_top", "t_middle", "t_base"]
    assert writers.drop_relation(spark, "t_other") == ["t_other"] and writers.drop_relation(spark, "t_other") == []


def test_table_is_read_by_name(spark, tmp_path):
    writers.save_table(spark.range(4), "saved_by_test", str(tmp_path / "saved"))
    writers.save_table(spark.range(6), "saved_by_test", str(tmp_path / "saved"))
    assert spark.sql("SELECT count(*) AS n FROM saved_by_test").first().n == 6
    spark.sql("DROP TABLE saved_by_test")


def test_protocols_within_cohorts(spark):
    rng = np.random.default_rng(2)

    def table(shift):
        rows = []
        for cohort, sign in (("one", 1.0), ("two", -1.0)):
            for pid in range(60):
                x = float(rng.normal())
                rows.append((cohort, pid, int(sign * x > 0), x + shift * float(rng.normal()), None))
        return spark.createDataFrame(rows, "cohort string, pid long, label int, a double, b double")

    got = models.newton_protocols(table(0.0), table(2.0), ["a", "b"], ["cohort"], rounds=5, depth=2, rate=0.5).collect()
    assert {(r.cohort, r.protocol) for r in got} == {(c, p) for c in ("one", "two") for p in ("TRTR", "TRTS", "TSTR", "TSTS")}
    assert all(r.accuracy >= 0.9 for r in got if r.protocol == "TRTR")
    both = models.newton_protocols(table(0.0).drop("cohort"), table(0.0).drop("cohort"), ["a", "b"], rounds=2, depth=1)
    assert both.count() == 4 and both.where(F.col("accuracy") > 1).count() == 0


def test_fast_gauss_transform_equals_pairs(spark):
    from wardframe.operators import metrics

    rng = np.random.default_rng(4)
    rows = [(g, float(y), float(p)) for g, scale in (("small", 1), ("large", 400), ("far", 1e7)) for y, p in scale * rng.normal(1, 1, (60, 2))]
    df = spark.createDataFrame([*rows, ("small", None, 1.0)], "g string, y double, yhat double")

    def k(a, b):
        return sum(np.exp(-0.5 * (a[:, None] - b[None, :]) ** 2 / w) for w in metrics.MMD_BANDWIDTHS)

    for r in metrics.gauss_mmd(df, ["g"]).collect():
        y, p = (np.array([row[i] for row in rows if row[0] == r.g]) for i in (1, 2))
        assert abs(r.mmd - np.mean(k(y, y) + k(p, p) - k(y, p) - k(p, y))) < 1e-10
    small = df.where("g = 'small'")
    assert abs(metrics.gauss_mmd(small).first().mmd - metrics.scalar_mmd(small).first().mmd) < 1e-9
    assert metrics.gauss_mmd(df.limit(0), ["g"]).count() == 0

"""The random draws behave like independent draws; lists and patterns hold what they should."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardframe.functions.ranks import hash_key, normal_draw, unit_draw
from wardframe.operators import metrics, notes as no, prescriptions, sampling
from wardframe.sources import codes
from wardframe.sources.note_catalogue import MEDICATIONS


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "pid")


def test_normal_draws_have_normal_moments_and_independent_streams(spark):
    rows = ids(spark, 20_000).select(normal_draw(F.col("pid"), 101).alias("a"), normal_draw(F.col("pid"), 202).alias("b")).toPandas()
    for c in "ab":
        x = rows[c]
        assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs(x.skew()) < 0.08 and abs(x.kurt()) < 0.15
    assert abs(np.corrcoef(rows["a"], rows["b"])[0, 1]) < 0.03
    assert abs(np.corrcoef(rows["a"][1:], rows["a"][:-1])[0, 1]) < 0.03


def test_unit_draws_of_two_seeds_are_independent(spark):
    rows = ids(spark, 20_000).select(unit_draw(F.col("pid"), 1).alias("a"), unit_draw(F.col("pid"), 2).alias("b")).toPandas()
    grid = np.histogram2d(rows["a"], rows["b"], bins=10, range=[[0, 1], [0, 1]])[0]
    assert ((grid - 200) ** 2 / 200).sum() < 160  # 99 degrees of freedom


def test_folds_of_two_repeats_overlap_by_chance(spark):
    folds = sampling.assign_folds(ids(spark, 5000), 5, 3)
    wide = folds.groupBy("pid").pivot("repeat", [1, 2, 3]).agg(F.first("fold")).toPandas()
    for a, b in ((1, 2), (1, 3), (2, 3)):
        table = np.histogram2d(wide[str(a)], wide[str(b)], bins=5)[0]
        assert table.sum() == 5000 and np.abs(table - 200).max() < 70


def test_bootstrap_multiplicities_are_multinomial(spark):
    rows = ids(spark, 4000).withColumn("g", F.lit(1))
    drawn = sampling.bootstrap_weights(rows, hash_key(F.col("pid"), 7), ("pid",), ("g",), replicates=4)
    times = drawn.groupBy("replicate").agg(F.count(F.lit(1)).alias("seen"), F.sum("times").alias("n"), F.sum(F.col("times") ** 2).alias("q")).collect()
    for r in times:
        assert r.n == 4000
        assert abs(r.seen / 4000 - 0.632) < 0.03 and abs(r.q / 4000 - 1 - 1.0) < 0.12


def test_masks_of_two_features_overlap_by_chance(spark):
    cells = ids(spark, 3000).select("pid", F.lit(1).alias("step"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("feature"), F.lit(1.0).alias("value"))
    masked = sampling.amputate(cells, ("a", "b"), 20.0).where("masked").groupBy("pid").count()
    both = masked.where("count = 2").count()
    assert masked.agg(F.sum("count")).first()[0] == 1200
    assert abs(both / 3000 - 0.04) < 0.015


def test_steps_beyond_a_thousand_do_not_collide(spark):
    rows = spark.createDataFrame([(1, 1000, "a"), (2, 0, "a")], "pid long, step int, feature string")
    assert rows.select(sampling.cell_key(("a",))).distinct().count() == 2


def test_drug_lists(spark):
    assert set(codes.DRUG_NAMES[1101751]) == {"rosuvastatin", "rosuvastatin calcium", "crestor", "ezallor"}
    assert len(codes.SURVEY_ONLY_NAMES) == 7
    assert set(codes.RX_MG_ITEMS) - {1101751} - set(codes.DRUG_NAMES) == set(codes.RX_MG_ITEMS) - set(codes.DRUG_NAMES)
    rows = spark.createDataFrame([("Crestor", "mg"), ("Bisoprolol", "mg"), ("Water", "ml")], "drug string, dose_unit_rx string")
    assert {r.drug for r in prescriptions.unit_survey(rows).collect()} == {"crestor", "bisoprolol"}
    dose = rows.withColumn("final_dosis", F.lit("20"))
    assert [(r.drug, r.itemid) for r in prescriptions.drug_items(dose).collect()] == [("Crestor", 1101751)]
    assert next(m for m in MEDICATIONS if m.itemid == 54836).rescale


@pytest.mark.parametrize("text", ["trop 2 days ago ", "troponin x 3 negative ", "ck-mb 12 "])
def test_counts_are_no_biomarkers(spark, text):
    row = spark.createDataFrame(
        [(1, 2, "2100-01-01 00:00:00", "Nursing", "d", text, None)],
        "subject_id long, hadm_id long, chartdate string, category string, description string, text string, iserror string",
    ).withColumn("chartdate", F.col("chartdate").cast("timestamp"))
    found = {r.ITEMID for r in no.flowsheet_biomarkers(row).collect()}
    assert not found & {227429, 51091}


def test_scalar_mmd_outside_the_series_is_refused_not_wrong(spark):
    rng = np.random.default_rng(2)
    y, p = rng.normal(3, 2, 60), rng.normal(4, 2, 60)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, yhat double")

    def mean_kernel(a, b):
        d = (a[:, None] - b[None, :]) ** 2
        return sum(np.exp(-0.5 * d / w).mean() for w in metrics.MMD_BANDWIDTHS)

    want = mean_kernel(y, y) + mean_kernel(p, p) - 2 * mean_kernel(y, p)
    assert metrics.scalar_mmd(df).first().mmd == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        metrics.scalar_mmd(df.select((F.col("y") + 120).alias("y"), (F.col("yhat") + 120).alias("yhat")))

"""First laboratory values of the first day of a stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.operators.cohort import of_cohort
from wardframe.sources import codes


def lab_dictionary(spark: SparkSession) -> DataFrame:
    """(itemid, label, upper limit): 27 fixed rows."""
    return spark.createDataFrame(
        [(i, label, float(top)) for i, label, top in codes.FIRST_DAY_LABS],
        "itemid int, label string, upper_limit double",
    )


def first_day_labs(
    stays: DataFrame,
    labevents: DataFrame,
    admissions: DataFrame,
    cohort: DataFrame | None = None,
    before: str = "INTERVAL '6' HOUR",
    after: str = "INTERVAL '1' DAY",
) -> DataFrame:
    """One row per stay, one column per lab: the largest value at the earliest time.

    "Rank times within (stay, label), keep the first, then pivot" needs a sort of every
    group. Here the readings are reduced to one value per (admission, label, time) before
    the interval join, then to the earliest time by a mergeable ``min_by``: all steps
    combine on the map side, so an admission with very many readings is no hot spot. The
    join is an inner one (either side may be split when skewed); stays without any lab
    come back with the final left join.
    """
    names = F.broadcast(lab_dictionary(stays.sparkSession))
    stays = of_cohort(stays, cohort)
    value = F.col("valuenum")
    readings = (
        labevents.filter(F.col("itemid").isin(*[i for i, _, _ in codes.FIRST_DAY_LABS]) & (value > 0))
        .join(names, "itemid")
        .groupBy("subject_id", "hadm_id", "label", "charttime")
        .agg(F.max(F.when(value <= F.col("upper_limit"), value)).alias("reading"))
    )
    spans = stays.select(
        "subject_id", "hadm_id", "icustay_id",
        (F.col("intime") - F.expr(before)).alias("since"),
        (F.col("intime") + F.expr(after)).alias("until"),
    )
    first = (
        readings.join(spans, ["subject_id", "hadm_id"])
        .filter(F.col("charttime").between(F.col("since"), F.col("until")))
        .groupBy("subject_id", "hadm_id", "icustay_id", "label")
        .agg(F.min_by("reading", "charttime").alias("reading"))
    )
    wide = (
        first.groupBy("subject_id", "hadm_id", "icustay_id")
        .pivot("label", list(codes.LAB_LABELS))
        .agg(F.max("reading"))
    )
    deaths = admissions.select("subject_id", "hadm_id", "admittime", "dischtime", "deathtime")
    died = F.col("deathtime")
    return (
        stays.select("subject_id", "hadm_id", "icustay_id", "intime", "outtime")
        .join(deaths, ["subject_id", "hadm_id"], "left")
        .join(wide, ["subject_id", "hadm_id", "icustay_id"], "left")
        .select(
            "subject_id", "hadm_id", "icustay_id",
            F.when(died.between(F.col("intime"), F.col("outtime")), 1).otherwise(0).alias("mort_icu"),
            F.when(died.between(F.col("admittime"), F.col("dischtime")), 1).otherwise(0).alias("mort_hosp"),
            *[F.col(label).alias(label.replace(" ", "") + "_1st") for label in codes.LAB_LABELS],
        )
    )

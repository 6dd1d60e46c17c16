"""Static conditions of patients and the examples built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.functions.units import round_half_even
from wardframe.sources import codes

CONDITION_COLUMNS = (
    "age", "gender", "diabetes", "hypertension", "heart_diseases",
    *[u.lower() for u in ("TSICU", "SICU", "MICU", "CCU", "CSRU")],
)


def _equals(name: str, value: str) -> Column:
    return F.coalesce((F.col(name) == value).cast("int"), F.lit(0))


def conditions(demographics: DataFrame) -> DataFrame:
    """Age, sex, comorbidities and intensive-care unit as numbers."""
    heart = F.col("Cardiac dysrhythmias") + F.col("Cardiac arrest and ventricular fibrillation")
    return demographics.select(
        F.col("PID").alias("pid"),
        round_half_even(F.col("AGE"), 1).alias("age"),
        _equals("GENDER", "M").alias("gender"),
        F.col("Diabetes mellitus").alias("diabetes"),
        F.col("Hypertension").alias("hypertension"),
        F.when(heart >= 1, 1).otherwise(0).alias("heart_diseases"),
        *[_equals("ICU", unit).alias(unit.lower()) for unit in codes.ICU_UNITS],
    )


def sex_text(flag: Column) -> Column:
    return F.when(flag == 1, "Hombre").otherwise("Mujer")


def unique_matches(demographics: DataFrame, series_ids: DataFrame) -> DataFrame:
    """``(pid, included)``: a patient counts only with exactly one demographics row."""
    single = (
        demographics.groupBy(F.col("PID").alias("pid")).count()
        .select("pid", (F.col("count") == 1).alias("__one"))
    )
    return (
        series_ids.select("pid").distinct()
        .join(single, "pid", "left")
        .select("pid", F.coalesce("__one", F.lit(False)).alias("included"))
    )


def matched_series(series: DataFrame, demographics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditions and series of the uniquely matched patients."""
    kept = unique_matches(demographics, series).filter("included").select("pid")
    return (
        conditions(demographics).join(kept, "pid", "left_semi"),
        series.join(kept, "pid", "left_semi"),
    )


def match_summary(series: DataFrame, demographics: DataFrame) -> DataFrame:
    return unique_matches(demographics, series).agg(
        F.count(F.when(F.col("included"), 1)).alias("patients_included"),
        F.count(F.when(~F.col("included"), 1)).alias("patients_removed"),
    )


def masked_targets(cells: DataFrame, value: str = "y", observed: str = "observed") -> DataFrame:
    """Unobserved targets become NULL."""
    return cells.withColumn(value, F.when(F.col(observed), F.col(value)))


def training_examples(
    series: DataFrame,
    mask: DataFrame,
    conditions_table: DataFrame,
    features: Sequence[str],
    n_in: int = 6,
    n_out: int = 6,
) -> DataFrame:
    """One row per patient: history and target matrices (step-major), target mask and
    condition vector. Series have a fixed small number of steps, so the arrays are bounded.
    """
    flags = mask.select("pid", "step", F.array(*[F.col(f) for f in features]).alias("seen"))
    steps = series.select("pid", "step", F.array(*[F.col(f) for f in features]).alias("values"))
    rows = steps.join(flags, ["pid", "step"]).filter(F.col("step") <= n_in + n_out)
    ordered = F.array_sort(F.collect_list(F.struct("step", "values", "seen")))
    packed = rows.groupBy("pid").agg(ordered.alias("rows"))

    def flat(field: str, first: int, count: int) -> Column:
        return F.flatten(F.transform(F.slice("rows", first, count), lambda r: r[field]))

    static = conditions_table.select(
        "pid", F.array(*[F.col(c).cast("double") for c in CONDITION_COLUMNS]).alias("conditions")
    )
    return (
        packed.filter(F.size("rows") >= n_in + n_out)
        .select(
            "pid",
            flat("values", 1, n_in).alias("past"),
            flat("values", n_in + 1, n_out).alias("target"),
            flat("seen", n_in + 1, n_out).alias("target_mask"),
        )
        .join(static, "pid")
    )


def labelled(examples: DataFrame, demographics: DataFrame) -> DataFrame:
    """Outcome label joined by patient id."""
    outcome = demographics.select(
        F.col("PID").alias("pid"), F.col("MORTALITY_INUNIT").cast("double").alias("label")
    )
    return examples.join(outcome, "pid")

"""From event rows to regular multivariate series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.functions.units import round_half_even


def step_of(start: Column, time: Column, hours: float) -> Column:
    """1-based step of a time after the start of the stay.

    The difference of zone-less timestamps is elapsed time; a timestamp function would
    bring in the session zone and its clock changes.
    """
    elapsed = ((time - start).cast("interval second").cast("decimal(18,6)") * 1000000).cast("long")
    return (F.floor(elapsed / F.lit(hours * 3600 * 1e6)) + 1).cast("int")


def series_grid(
    observations: DataFrame,
    stays: DataFrame,
    features: Sequence[str],
    hours: float = 1.0,
    steps: int = 48,
) -> DataFrame:
    """``(pid, step, one column per feature)``: mean of the readings in each step.

    Empty steps come from spine rows that join the same aggregation, so the grid costs one
    shuffle on (pid, step) with map-side partial means: neither a pivot nor an outer join,
    and no single patient's rows have to meet in one task.
    """
    placed = observations.join(stays.select("pid", "intime"), "pid").select(
        "pid", step_of(F.col("intime"), F.col("charttime"), hours).alias("step"), "feature", "value"
    )
    spine = stays.select(
        "pid",
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"),
        F.lit(None).cast("string").alias("feature"),
        F.lit(None).cast("double").alias("value"),
    )
    readings = placed.filter(F.col("step").between(1, steps) & F.col("feature").isin(*features))
    return readings.unionByName(spine).groupBy("pid", "step").agg(
        *[F.avg(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features]
    )


def bucket_mean(series: DataFrame, features: Sequence[str], size: int = 4, digits: int = 2) -> DataFrame:
    """Mean of each ``size`` consecutive steps, missing steps ignored, NumPy rounding."""
    bucket = (F.floor((F.col("step") - 1) / size) + 1).cast("int")
    return series.groupBy("pid", bucket.alias("step")).agg(
        *[round_half_even(F.avg(f), digits).alias(f) for f in features]
    )


def observed_mask(series: DataFrame, features: Sequence[str]) -> DataFrame:
    """True where a value was really observed."""
    return series.select("pid", "step", *[F.col(f).isNotNull().alias(f) for f in features])


def all_observed_mask(series: DataFrame, features: Sequence[str]) -> DataFrame:
    """External data come without a mask: everything counts as observed."""
    return series.select("pid", "step", *[F.lit(True).alias(f) for f in features])


def to_long(series: DataFrame, features: Sequence[str], value: str = "value", keys: Sequence[str] = ("pid", "step")) -> DataFrame:
    """One row per cell; a projection, no shuffle."""
    return series.unpivot(list(keys), list(features), "feature", value)


def to_wide(
    cells: DataFrame, features: Sequence[str], value: str = "value", keys: Sequence[str] = ("pid", "step")
) -> DataFrame:
    return cells.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == f, F.col(value))).alias(f) for f in features]
    )


def patient_vector(series: DataFrame, features: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """One row per patient with a column per (feature, step)."""
    return series.groupBy("pid").agg(
        *[
            F.max(F.when(F.col("step") == s, F.col(f))).alias(f"{f}_{s}")
            for s in steps
            for f in features
        ]
    )


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).dropna()


def complete_groups(series: DataFrame, rows: int = 12) -> DataFrame:
    """Patients with at least ``rows`` rows; counted with partial aggregation."""
    enough = series.groupBy("pid").count().filter(F.col("count") >= rows)
    return series.join(enough.select("pid"), "pid", "left_semi")

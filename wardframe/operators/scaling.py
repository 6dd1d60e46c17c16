"""Min-max scaling, fitted on one table and applied to others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.functions.units import round_half_even, scale_to, unscale_from
from wardframe.operators.grid import to_long


def fit_scaler(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, low, high)``: one row per feature, the persistable form."""
    bounds = train.agg(
        *[F.min(f).alias(f"low_{f}") for f in features], *[F.max(f).alias(f"high_{f}") for f in features]
    )
    entries = [
        F.struct(F.lit(f).alias("feature"), F.col(f"low_{f}").alias("low"), F.col(f"high_{f}").alias("high"))
        for f in features
    ]
    return bounds.select(F.inline(F.array(*entries)))


def _bound_map(params: DataFrame) -> Column:
    """All bounds as one scalar subquery (a map of a few entries): no join, one scan,
    shared by every column that refers to it."""
    entry = F.struct("feature", F.struct("low", "high").alias("bounds"))
    return params.agg(F.map_from_entries(F.collect_list(entry)).alias("bounds")).scalar()


def scale_series(
    series: DataFrame, params: DataFrame, features: Sequence[str], lo: float = -1.0, hi: float = 1.0
) -> DataFrame:
    """Scaled features; every other column (keys included) travels along."""
    rest = [c for c in series.columns if c not in features]
    bounds = F.col("__bounds")
    scaled = [
        scale_to(F.col(f), bounds[f]["low"], bounds[f]["high"], lo, hi).alias(f) for f in features
    ]
    return series.withColumn("__bounds", _bound_map(params)).select(*rest, *scaled)


def unscale_series(
    series: DataFrame,
    params: DataFrame,
    features: Sequence[str],
    lo: float = -1.0,
    hi: float = 1.0,
    digits: int = 2,
) -> DataFrame:
    rest = [c for c in series.columns if c not in features]
    bounds = F.col("__bounds")
    raw = [
        round_half_even(
            unscale_from(F.col(f), bounds[f]["low"], bounds[f]["high"], lo, hi), digits
        ).alias(f)
        for f in features
    ]
    return series.withColumn("__bounds", _bound_map(params)).select(*rest, *raw)


def fit_cells(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Scaler of long rows, per feature (and group)."""
    return cells.groupBy(*groups, "feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def scale_cells(cells: DataFrame, params: DataFrame, columns: Sequence[str] = ("value",), lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Scale value columns of long rows. ``params`` has one row per feature, a fixed small
    number, so it is broadcast: a shuffle on seven feature names would be all skew."""
    joined = cells.join(F.broadcast(params), "feature")
    for c in columns:
        joined = joined.withColumn(c, scale_to(F.col(c), F.col("low"), F.col("high"), lo, hi))
    return joined.drop("low", "high")


def unscale_cells(
    cells: DataFrame, params: DataFrame, columns: Sequence[str] = ("value",), lo: float = 0.0, hi: float = 1.0, digits: int | None = 2
) -> DataFrame:
    joined = cells.join(F.broadcast(params), "feature")
    for c in columns:
        raw = unscale_from(F.col(c), F.col("low"), F.col("high"), lo, hi)
        joined = joined.withColumn(c, raw if digits is None else round_half_even(raw, digits))
    return joined.drop("low", "high")


def scaled_long(series: DataFrame, params: DataFrame, features: Sequence[str], lo: float, hi: float) -> DataFrame:
    return scale_cells(to_long(series, features), params, ("value",), lo, hi)

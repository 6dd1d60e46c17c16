"""Ordered-row operators on series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, order: Sequence[str], n: int, name: str = "step") -> DataFrame:
    """First ``n`` rows of each patient. The rank limit is also applied before the shuffle
    (group limit), so a patient with very many rows sends only ``n`` per task."""
    w = Window.partitionBy("pid").orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def split_history_target(rows: DataFrame, order: Sequence[str], n_in: int = 6, n_out: int = 6) -> DataFrame:
    """First ``n_in`` rows are history, the next ``n_out`` the target."""
    ranked = first_rows(rows, order, n_in + n_out)
    return ranked.withColumn("part", F.when(F.col("step") <= n_in, "history").otherwise("target"))


def edge_pad(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Bring each patient to ``n`` steps by repeating the first row at the top."""
    ranked = first_rows(rows, order, n, "__row")
    missing = F.lit(n) - F.count(F.lit(1)).over(Window.partitionBy("pid"))
    place = F.when(F.col("__row") == 1, F.sequence(F.lit(1), (missing + 1).cast("int"))).otherwise(
        F.array((F.col("__row") + missing).cast("int"))
    )
    return ranked.withColumn("__place", place).select("*", F.explode("__place").alias("step")).drop("__row", "__place")


def dilated_causal_filter(
    series: DataFrame, weights: Mapping[str, Sequence[float]], dilation: int, name: str = "response"
) -> DataFrame:
    """Causal convolution over all input channels: sum of w[k] * x[t - k * dilation], with
    zero before the start of the series."""
    w = Window.partitionBy("pid").orderBy("step")
    terms = [
        F.lit(float(weight)) * F.coalesce(F.lag(channel, k * dilation).over(w) if k else F.col(channel), F.lit(0.0))
        for channel, kernel in weights.items()
        for k, weight in enumerate(kernel)
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return series.withColumn(name, total)

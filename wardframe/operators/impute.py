"""Imputation of masked cells: column statistics, interpolation, resampling, expectation
maximisation; scoring against known truth.

Cells are long rows ``(groups..., pid, step, feature, value)``; ``groups`` such as
(rep, pct) let one plan serve a whole experiment. Observed cells are never changed; the
result is in ``imputed``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardframe.functions.ranks import exact_rank, hash_key, normal_draw
from wardframe.operators.sampling import cell_key
from wardframe.session import cut_lineage, scratch_path

EM_LOOPS = 5


def _feature_table(stats: DataFrame) -> DataFrame:
    """Per-feature statistics: at most features x repetitions x rates rows, a number set by
    the experiment and not by the data, so the broadcast stays small."""
    return F.broadcast(stats)


def fill_mean(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    keys = [*groups, "feature"]
    means = cells.groupBy(*keys).agg(F.avg("value").alias("__mean"))
    return cells.join(_feature_table(means), keys).withColumn(
        "imputed", F.coalesce("value", "__mean")
    ).drop("__mean")


def fill_linear(cells: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation by step within a patient; ends take the nearest value."""
    w = Window.partitionBy(*groups, "pid", "feature").orderBy("step")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("step"))
    v0, s0 = F.last("value", True).over(back), F.last(at, True).over(back)
    v1, s1 = F.first("value", True).over(ahead), F.first(at, True).over(ahead)
    placed = cells.select("*", v0.alias("__v0"), s0.alias("__s0"), v1.alias("__v1"), s1.alias("__s1"))
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("step") - F.col("__s0")) / (
        F.col("__s1") - F.col("__s0")
    )
    between = F.when(F.col("__s1") > F.col("__s0"), between)
    return placed.withColumn("imputed", F.coalesce("value", between, "__v0", "__v1")).drop(
        "__v0", "__s0", "__v1", "__s1"
    )


def fill_moving(cells: DataFrame, groups: Sequence[str] = (), half_width: int = 2) -> DataFrame:
    """Mean of a centred window of steps; what is still missing becomes 0."""
    w = Window.partitionBy(*groups, "pid", "feature").orderBy("step").rowsBetween(-half_width, half_width)
    return cells.withColumn("imputed", F.coalesce("value", F.avg("value").over(w), F.lit(0.0)))


def fill_random(
    cells: DataFrame, features: Sequence[str], groups: Sequence[str] = (), seed: int = 242
) -> DataFrame:
    """A random observed value of the same column.

    Observed values are numbered; a missing cell hashes to a number and meets its donor by
    an equi-join, so donors are neither collected nor broadcast.
    """
    keys = [*groups, "feature"]
    keyed = cells.withColumn("__key", cell_key(features, seed))
    observed = keyed.filter(F.col("value").isNotNull())
    donors = exact_rank(observed, "__key", ("pid", "step"), keys, rank="__donor", total=None)
    donors = donors.select(*keys, "__donor", F.col("value").alias("__drawn"))
    counts = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    pick = F.when(
        F.col("value").isNull(), F.pmod(hash_key(F.col("__key"), seed + 1), F.col("__n")) + 1
    )
    asked = keyed.join(_feature_table(counts), keys, "left").withColumn("__donor", pick)
    missing = asked.filter(F.col("value").isNull()).join(donors, [*keys, "__donor"], "left")
    kept = asked.filter(F.col("value").isNotNull()).withColumn("__drawn", F.col("value"))
    return missing.unionByName(kept).withColumnRenamed("__drawn", "imputed").drop("__key", "__n", "__donor")


def fill_em(
    cells: DataFrame, features: Sequence[str], groups: Sequence[str] = (), loops: int = EM_LOOPS, seed: int = 242
) -> DataFrame:
    """Column-Gaussian expectation maximisation.

    Each loop re-estimates mean and deviation from observed and drawn values and draws the
    missing cells again. The draws z of every loop depend on the cell only, so sums of z
    and z*z from one pass determine all loops; no iteration over the data is needed.
    """
    keys = [*groups, "feature"]
    key = cell_key(features, seed)
    gap = F.col("value").isNull()
    draws = [F.when(gap, normal_draw(F.col("__key"), 101 * (i + 1))).alias(f"d{i}") for i in range(loops - 1)]
    drawn_rows = cells.select(*keys, "value", key.alias("__key")).select(*keys, "value", *draws)
    stats = drawn_rows.groupBy(*keys).agg(
        F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"),
        F.count(F.when(gap, 1)).alias("m"),
        *[F.coalesce(F.sum(f"d{i}"), F.lit(0.0)).alias(f"z{i}") for i in range(loops - 1)],
        *[F.coalesce(F.sum(F.col(f"d{i}") * F.col(f"d{i}")), F.lit(0.0)).alias(f"y{i}") for i in range(loops - 1)],
    )
    mu = F.try_divide("s", "n")
    stats = stats.withColumn("mu", mu).withColumn(
        "sd", F.sqrt(F.greatest(F.try_divide("q", "n") - mu * mu, F.lit(0.0)))
    )
    for i in range(loops - 1):
        count = F.col("n") + F.col("m")
        mu_next = (F.col("s") + F.col("m") * F.col("mu") + F.col("sd") * F.col(f"z{i}")) / count
        square = (
            F.col("q") + F.col("m") * F.col("mu") * F.col("mu")
            + 2 * F.col("mu") * F.col("sd") * F.col(f"z{i}") + F.col("sd") * F.col("sd") * F.col(f"y{i}")
        ) / count
        stats = stats.withColumn("mu_next", mu_next).withColumn(
            "sd", F.sqrt(F.greatest(square - F.col("mu_next") * F.col("mu_next"), F.lit(0.0)))
        ).withColumn("mu", F.col("mu_next")).drop("mu_next")
    stats = stats.select(*keys, F.col("mu").alias("__mu"), F.col("sd").alias("__sd"))
    drawn = F.col("__mu") + F.col("__sd") * normal_draw(key, 101 * loops)
    return cells.join(_feature_table(stats), keys).withColumn(
        "imputed", F.coalesce(F.col("value"), drawn)
    ).drop("__mu", "__sd")


def column_methods(features: Sequence[str]) -> dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]]:
    """Imputers that work on long rows, by method name."""
    return {
        "simple": fill_mean,
        "interpolate_linear": fill_linear,
        "random": lambda c, g: fill_random(c, features, g),
        "expectation_maximization": lambda c, g: fill_em(c, features, g),
        "moving_window": fill_moving,
    }


def masked_rmse(imputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE over masked cells only, pooled over columns."""
    error = F.col("truth") - F.col("imputed")
    return imputed.filter("masked").groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("cells")
    )


def score_grid(
    experiment: DataFrame,
    methods: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]],
    groups: Sequence[str] = ("rep", "pct"),
) -> DataFrame:
    """``(method, rep, pct, rmse)`` of every method over the whole experiment table."""
    out = None
    for name, fill in methods.items():
        scored = masked_rmse(fill(experiment, groups), groups).withColumn("method", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out


def timed_grid(
    experiment: DataFrame,
    methods: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]],
    reps: Sequence[int],
    rates: Sequence[int],
) -> DataFrame:
    """``(method, rep, pct, rmse, cells, seconds)``: every method on every (rep, pct), each run by itself and timed.

    The seconds are wall time of imputing and scoring, as the driver sees it. The log has one row
    a run, so it is bounded by the experiment and not by the data.
    """
    spark = experiment.sparkSession
    path = scratch_path(spark, "experiment")
    experiment.write.partitionBy("rep", "pct").parquet(path)
    stored = spark.read.parquet(path)
    log = []
    for rep in reps:
        for pct in rates:
            part = cut_lineage(stored.filter((F.col("rep") == rep) & (F.col("pct") == pct)))
            for name, fill in methods.items():
                began = time.monotonic()
                row = masked_rmse(fill(part, ("rep", "pct")), ("rep", "pct")).first()
                seconds = time.monotonic() - began
                if row is not None:
                    log.append((name, rep, pct, row["rmse"], row["cells"], seconds))
    return spark.createDataFrame(log, "method string, rep int, pct int, rmse double, cells long, seconds double")


def grouped_log(
    experiment: DataFrame,
    methods: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]],
    groups: Sequence[str] = ("rep", "pct"),
) -> DataFrame:
    """``(method, rep, pct, rmse, cells, seconds)``: each method imputes the whole experiment in one run.

    The seconds of a method's run, as the driver sees them, are shared out over its (rep, pct) by
    their masked cells. The log has one row for each method and (rep, pct); it is bounded by the
    experiment, not by the data.
    """
    spark = experiment.sparkSession
    path = scratch_path(spark, "experiment")
    experiment.write.parquet(path)
    stored = spark.read.parquet(path)
    log = []
    for name, fill in methods.items():
        began = time.monotonic()
        rows = masked_rmse(fill(stored, groups), groups).collect()
        seconds = time.monotonic() - began
        total = sum(r["cells"] for r in rows)
        log += [(name, *[r[g] for g in groups], r["rmse"], r["cells"], seconds * r["cells"] / total) for r in rows]
    keys = ", ".join(f"{g} {experiment.schema[g].dataType.simpleString()}" for g in groups)
    return spark.createDataFrame(log, f"method string, {keys}, rmse double, cells long, seconds double")

"""Deterministic sampling: amputation, patient samples, folds, splits, resampling.

Randomness is a hash of the row's identity and a seed, so results do not depend on the
partitioning and survive a re-run of a lost task. Global ranks use ``exact_rank``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.functions.ranks import among_first, exact_rank, hash_key


def cell_key(features: Sequence[str], seed: Column | int = 0) -> Column:
    """Hash of a cell (pid, step, feature)."""
    place = F.concat_ws(":", F.col("pid").cast("string"), F.col("step").cast("string"), "feature")
    return hash_key(place, seed)


def amputate(
    cells: DataFrame, features: Sequence[str], pct: Column | float = 20.0, seed: Column | int = 242, groups: Sequence[str] = (),
) -> DataFrame:
    """Hide ``round(n * pct / 100)`` observed cells of every feature.

    Adds ``truth`` (the original) and ``masked``; ``value`` becomes NULL where masked.
    """
    share = F.lit(pct) if isinstance(pct, (int, float)) else pct
    keyed = cells.select("*", cell_key(features, seed).alias("__key"), F.col("value").alias("truth"))
    wanted = F.round(F.col("__total") * share / 100)
    hidden = among_first(keyed, "__key", ("pid", "step"), (*groups, "feature"), wanted, "masked", F.col("value").isNotNull())
    return hidden.withColumn("value", F.when(~F.col("masked"), F.col("value"))).drop("__key")


def experiment_cells(
    cells: DataFrame, features: Sequence[str], reps: int = 10, rates: Sequence[int] = (10, 20, 30, 40, 50)
) -> DataFrame:
    """Every (repetition, rate) of the imputation experiment as rows of one table."""
    grid = F.array(*[
        F.struct(F.lit(r).alias("rep"), F.lit(p).alias("pct")) for r in range(reps) for p in rates
    ])
    spread = cells.select("*", F.inline(grid))
    return amputate(
        spread, features, F.col("pct"), F.col("rep") * 100 + F.col("pct"), ("rep", "pct")
    )


def first_patients(series: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` smallest patient ids (a top-n, not an arbitrary limit)."""
    chosen = series.select("pid").distinct().orderBy("pid").limit(n)
    return series.join(chosen, "pid", "left_semi")


def sample_patients(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` patients without replacement."""
    keyed = ids.select("pid").distinct().withColumn("__key", hash_key(F.col("pid"), seed))
    return exact_rank(keyed, "__key", ("pid",), rank="draw", total=None).filter(F.col("draw") <= n).drop("__key")


def assign_folds(ids: DataFrame, k: int = 5, repeats: int = 10) -> DataFrame:
    """Repeated k-fold: ``(repeat, pid, fold)`` with fold sizes that differ by at most one."""
    spread = ids.select("pid").distinct().select(
        "pid", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")
    )
    keyed = spread.withColumn("__key", hash_key(F.col("pid"), F.col("repeat")))
    ranked = exact_rank(keyed, "__key", ("pid",), ("repeat",), total=None)
    return ranked.select("repeat", "pid", ((F.col("rank") - 1) % k).cast("int").alias("fold"))


def stratified_split(rows: DataFrame, ident: str, label: str, test: float = 0.2, seed: int = 1) -> DataFrame:
    """Adds ``subset``: within each label the share ``test`` is held out."""
    keyed = rows.withColumn("__key", hash_key(F.col(ident), seed))
    kept = F.floor(F.col("__total") * (1 - test) + 1e-9)
    split = among_first(keyed, "__key", (ident,), (label,), kept, "__kept")
    return split.withColumn("subset", F.when(F.col("__kept"), "train").otherwise("test")).drop("__key", "__kept")


def shuffled(ids: DataFrame, seed: int = 1) -> DataFrame:
    """A reproducible training order."""
    keyed = ids.select("pid").distinct().withColumn("__key", hash_key(F.col("pid"), seed))
    return exact_rank(keyed, "__key", ("pid",), rank="position", total=None).drop("__key")


def batches(ids: DataFrame, size: int = 32, seed: int = 1) -> DataFrame:
    """Training batches of exactly ``size`` patients (the last may be smaller)."""
    return shuffled(ids, seed).select("pid", F.floor((F.col("position") - 1) / size).alias("batch"))


def bootstrap_weights(
    rows: DataFrame, key: Column, ties: Sequence[str], groups: Sequence[str], replicates: int = 10, seed: int = 123
) -> DataFrame:
    """Multinomial resampling with replacement as multiplicities.

    Each replicate draws, for every row, one row number of its group; draws are counted
    per row number before they meet the data. ``(rows..., replicate, times)``.
    """
    numbered = exact_rank(rows.withColumn("__key", key), "__key", ties, groups, rank="__row", total="__n")
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    drawn = (
        numbered.select(*groups, "__row", "__n", reps)
        .withColumn("__row", F.pmod(hash_key(F.col("__row"), F.col("replicate") * 31 + seed), F.col("__n")) + 1)
        .groupBy(*groups, "replicate", "__row")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return numbered.join(drawn, [*groups, "__row"]).drop("__key", "__row", "__n")


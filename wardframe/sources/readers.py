"""Readers: base tables, series CSV files and legacy position-coded text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.functions.ranks import positions
from wardframe.functions.units import nan_to_null
from wardframe.sources.schemas import TABLES, series_schema

_BLOCK = ("__file", "__offset")


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One clinical base table; parquet keeps pushdown and column pruning."""
    path = os.path.join(root, f"{name}.{fmt}")
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    if fmt == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return reader.format(fmt).load(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals a scan over the session's cores if it is stored in fewer splits than those.

    For heavy work on texts that came as few files: one split is one task. A table of many splits
    stays as it is, so large inputs are never shuffled for it. ``df`` is a scan with projections
    and filters (a plan with joins would be run to be counted).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def read_series(
    spark: SparkSession, path: str, features: tuple[str, ...], kind: str = "double", saved_index: bool = True
) -> DataFrame:
    """Series or mask CSV; drops the saved index column and turns NaN into NULL."""
    df = spark.read.option("header", True).schema(series_schema(features, kind, saved_index)).csv(path)
    df = df.drop("_c0")
    if kind != "double":
        return df
    return df.select("pid", *[nan_to_null(F.col(f)).alias(f) for f in features])


def _with_block(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__offset"),
    )


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """One number per line (or several separated by blanks): ``position, value``.

    The first line is data, not a header.
    """
    lines = _with_block(spark.read.text(path))
    numbered = positions(lines, _BLOCK, "line")
    values = F.split(F.trim("value"), " +")
    return (
        numbered.select("line", F.posexplode(values).alias("token", "text"))
        .select("line", "token", F.col("text").try_cast("double").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def read_vector(
    spark: SparkSession, path: str, features: tuple[str, ...], steps: int
) -> DataFrame:
    """One-number-per-line vector in (patient, step, feature) order, back to long rows."""
    width = len(features)
    names = F.array(*[F.lit(f) for f in features])
    line = F.col("line")
    return read_metric_lines(spark, path).select(
        F.floor(line / (steps * width)).alias("patient"),
        (F.floor(line / width) % steps + 1).cast("int").alias("step"),
        F.element_at(names, (line % width + 1).cast("int")).alias("feature"),
        "value",
    )


def read_external_series(
    spark: SparkSession, samples: str, pids: str, features: tuple[str, ...], steps: int = 48
) -> DataFrame:
    """External samples hold ``steps`` rows per patient, the id list one row per patient;
    both are matched by position."""
    rows = _with_block(
        spark.read.option("header", True)
        .schema("_c0 long" + "".join(f", `{f}` double" for f in features))
        .csv(samples)
    )
    ids = _with_block(spark.read.option("header", True).schema("_c0 long, `0` long").csv(pids))
    rows = positions(rows, _BLOCK, "line").select(
        F.floor(F.col("line") / steps).alias("slot"),
        (F.col("line") % steps + 1).cast("int").alias("step"),
        *[nan_to_null(F.col(f)).alias(f) for f in features],
    )
    ids = positions(ids, _BLOCK, "slot").select("slot", F.col("0").alias("pid"))
    return rows.join(ids, "slot").select("pid", "step", *features)

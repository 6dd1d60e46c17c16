"""Sinks: exports, partitioned results, scaler and model persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.functions.text import flatten_lines
from wardframe.sources import codes


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header. Quotes are doubled so that note text survives a round trip."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Columnar export.

    Rows are not shuffled to their partition value: every task writes its own file per
    value, so one value that holds a third of the rows still spreads over many tasks.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export_imputed(df: DataFrame, path: str) -> None:
    """Imputed data, one folder per method and missing rate."""
    export_parquet(df, path, ("method", "pct"))


def export_vector(df: DataFrame, path: str) -> None:
    """Long ``(pid, step, feature, value)`` rows instead of order-dependent text."""
    export_parquet(df.select("pid", "step", "feature", "value"), path)


def export_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_scaler(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, low double, high double").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def flat_notes(notes: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Notes of the exported categories with line breaks turned into blanks."""
    picked = notes.filter(F.col("category").isin(*codes.NOTE_CATEGORIES))
    if cohort is not None:
        picked = picked.join(cohort.select("subject_id"), "subject_id", "left_semi")
    return picked.select(
        "subject_id", "hadm_id", "chartdate", "category", flatten_lines(F.col("text")).alias("texto")
    )


def export_notes(notes: DataFrame, path: str, cohort: DataFrame | None = None) -> None:
    export_parquet(flat_notes(notes, cohort), path, ("category",))


def publish(df: DataFrame, name: str) -> None:
    """Named relation for SQL users; replaces an earlier one."""
    df.createOrReplaceTempView(name)


def _walk(plan) -> list:
    """Nodes of an analysed plan, subquery plans included."""
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        found.append(node)
        for children in (node.children(), node.subqueries()):
            todo += [children.apply(i) for i in range(children.size())]
    return found


def references(df: DataFrame) -> set[str]:
    """Names of the published relations that the plan of ``df`` reads, directly or through others."""
    nodes = _walk(df._jdf.queryExecution().analyzed())
    return {n.desc().identifier().table().lower() for n in nodes if n.nodeName() == "View"}


def dependants(spark: SparkSession, name: str) -> list[str]:
    """Published relations that read ``name``, those that read most of the others first."""
    views = [t.name.lower() for t in spark.catalog.listTables() if t.isTemporary]
    reads = {v: references(spark.table(v)) - {v} for v in views}
    return sorted((v for v in views if name.lower() in reads[v]), key=lambda v: (-len(reads[v]), v))


def drop_relation(spark: SparkSession, name: str, cascade: bool = False) -> list[str]:
    """``DROP ... [CASCADE]``: refuses to drop a relation that others read, or drops those first.

    Returns the dropped names in order; an unknown name drops nothing.
    """
    others = dependants(spark, name)
    if others and not cascade:
        raise ValueError(f"{name} is read by {', '.join(others)}; drop them first or cascade")
    return [v for v in [*others, name.lower()] if spark.catalog.dropTempView(v)]


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """``CREATE TABLE ... AS SELECT``; with ``path`` the table lies there."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)

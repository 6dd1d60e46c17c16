"""Chart events as they arrive: the same row-wise extractor, checkpointed sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardframe.operators.events import chart_measurements
from wardframe.operators.cohort import of_cohort
from wardframe.sources.schemas import TABLES


def chart_stream(spark: SparkSession, path: str, cohort: DataFrame | None = None) -> DataFrame:
    """New chart-event files under ``path``, cleaned; a static cohort may restrict them."""
    raw = spark.readStream.schema(TABLES["chartevents"]).parquet(path)
    return chart_measurements(of_cohort(raw, cohort))


def write_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; restarts continue from the checkpoint."""
    return (
        events.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )

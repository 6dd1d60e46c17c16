"""Charted, laboratory, infusion and output events in canonical units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.functions.units import charted_measure, charted_unit, round_half_up
from wardframe.operators.cohort import of_cohort
from wardframe.sources import codes


def _no_error() -> Column:
    return F.coalesce(F.col("error"), F.lit(0)) == 0


def chart_measurements(table: DataFrame) -> DataFrame:
    """Row-wise part of the chart extractor: also valid on a stream."""
    return table.filter(_no_error() & (F.col("valuenum") > 0)).select(
        F.col("subject_id").alias("SUBJECT_ID"),
        F.col("hadm_id").alias("HADM_ID"),
        F.col("icustay_id").alias("ICUSTAY_ID"),
        F.col("itemid").alias("ITEMID"),
        F.col("charttime").alias("CHARTTIME"),
        F.col("storetime").alias("STORETIME"),
        round_half_up(charted_measure(F.col("itemid"), F.col("valuenum")), 2).alias("VALUE"),
        charted_unit(F.col("valueuom")).alias("VALUEUOM"),
        F.col("warning").alias("WARNING"),
        F.col("resultstatus").alias("RESULTSTATUS"),
        F.col("stopped").alias("STOPPED"),
    )


def chart_events(table: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Chart events without error, positive raw value, converted and rounded."""
    return chart_measurements(of_cohort(table, cohort))


def lab_events(table: DataFrame, cohort: DataFrame | None) -> DataFrame:
    unit = F.lower("valueuom")
    return of_cohort(table.filter(F.col("valuenum") > 0), cohort).select(
        F.col("subject_id").alias("SUBJECT_ID"),
        F.col("hadm_id").alias("HADM_ID"),
        F.col("itemid").alias("ITEMID"),
        F.col("charttime").alias("CHARTTIME"),
        round_half_up(charted_measure(F.col("itemid"), F.col("valuenum")), 2).alias("VALUE"),
        F.when(unit == "inch", F.lit("cm"))
        .when(unit == "deg. f", F.lit("Deg. C"))
        .otherwise(F.col("valueuom"))
        .alias("VALUEUOM"),
    )


def accepted_pair(unit_text: str) -> Column:
    """(item, unit) pairs in which an infused amount is accepted."""
    item, unit = F.col("itemid"), F.lower("amountuom")
    return (item.isin(*codes.INPUT_MG_ITEMS) & (unit == "mg")) | (
        item.isin(*codes.INPUT_UNIT_ITEMS) & (unit == unit_text)
    )


def _inputs(table: DataFrame, cohort: DataFrame | None, time: str, unit_text: str) -> DataFrame:
    kept = table.filter(
        F.col("itemid").isin(*codes.INPUT_ITEMS) & (F.col("amount") > 0) & accepted_pair(unit_text)
    )
    return of_cohort(kept, cohort).select(
        F.col("subject_id").alias("SUBJECT_ID"),
        F.col("hadm_id").alias("HADM_ID"),
        F.col("icustay_id").alias("ICUSTAY_ID"),
        F.col(time).alias("CHARTTIME"),
        F.col("itemid").alias("ITEMID"),
        round_half_up(F.col("amount"), 2).alias("VALUE"),
        F.col("amountuom").alias("VALUEUOM"),
    )


def input_events_cv(table: DataFrame, cohort: DataFrame | None) -> DataFrame:
    return _inputs(table, cohort, "charttime", codes.INPUT_UNIT_TEXT["cv"])


def input_events_mv(table: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """As the other system, without rewritten orders (a NULL status goes too)."""
    valid = table.filter(F.col("statusdescription") != codes.REWRITTEN_STATUS)
    return _inputs(valid, cohort, "starttime", codes.INPUT_UNIT_TEXT["mv"])


def output_events(table: DataFrame, cohort: DataFrame | None) -> DataFrame:
    wanted = ("subject_id", "hadm_id", "icustay_id", "charttime", "itemid", "value", "valueuom")
    kept = of_cohort(table.filter(F.col("value") > 0), cohort)
    return kept.select(*[F.col(c).alias(c.upper()) for c in wanted], "iserror")

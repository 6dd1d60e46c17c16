"""Ventilation state per stay and time, and its event form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.operators.cohort import of_cohort
from wardframe.sources import codes


def _mechanical(item: Column, value: Column) -> Column:
    return (
        ((item == codes.VENT_TYPE_ITEM) & (value != codes.VENT_TYPE_EXCLUDED))
        | ((item == codes.VENT_MODE_TYPE_ITEM) & (value != codes.VENT_MODE_TYPE_EXCLUDED))
        | (item == codes.VENT_MODE_ITEM)
        | ((item == codes.O2_DEVICE_ITEM_CV) & (value == "Ventilator"))
        | item.isin(*codes.VENT_SETTING_ITEMS)
    )


def _oxygen(item: Column, value: Column) -> Column:
    return ((item == codes.O2_DEVICE_ITEM_MV) & value.isin(*codes.O2_DEVICES_MV)) | (
        (item == codes.O2_DEVICE_ITEM_CV) & value.isin(*codes.O2_DEVICES_CV)
    )


def _flag(condition: Column, name: str) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).alias(name)


def ventilation_state(
    chartevents: DataFrame,
    procedures: DataFrame,
    stays: DataFrame | None = None,
    cohort: DataFrame | None = None,
) -> DataFrame:
    """Four indicators per (stay, time) from charted settings, plus extubation procedures.

    One item list serves both the row filter and the indicators. Procedures carry no
    subject, so they are restricted through ``stays`` when a cohort is given.
    """
    item, value = F.col("itemid"), F.col("value")
    relevant = (
        codes.VENT_TYPE_ITEM, codes.VENT_MODE_TYPE_ITEM, codes.VENT_MODE_ITEM,
        codes.O2_DEVICE_ITEM_CV, codes.O2_DEVICE_ITEM_MV, codes.EXTUBATION_ITEM,
        *codes.VENT_SETTING_ITEMS, *codes.O2_OTHER_ITEMS,
    )
    charted = chartevents.filter(
        value.isNotNull() & ((F.col("error") != 1) | F.col("error").isNull()) & item.isin(*relevant)
    )
    states = of_cohort(charted, cohort).groupBy("icustay_id", "charttime").agg(
        _flag(_mechanical(item, value), "mech_vent"),
        _flag(_oxygen(item, value), "oxygen_therapy"),
        _flag((item == codes.EXTUBATION_ITEM) & value.isin(*codes.EXTUBATED_VALUES), "extubated"),
        _flag((item == codes.EXTUBATION_ITEM) & (value == codes.SELF_EXTUBATED_VALUE), "self_extubated"),
    )
    done = procedures.filter(item.isin(*codes.EXTUBATION_PROCEDURES))
    if cohort is not None and stays is not None:
        done = done.join(of_cohort(stays, cohort).select("icustay_id"), "icustay_id", "left_semi")
    flags = done.select(
        "icustay_id",
        F.col("starttime").alias("charttime"),
        F.lit(0).alias("mech_vent"),
        F.lit(0).alias("oxygen_therapy"),
        F.lit(1).alias("extubated"),
        F.when(item == codes.SELF_EXTUBATION_PROCEDURE, 1).otherwise(0).alias("self_extubated"),
    )
    return states.unionByName(flags).distinct()


def ventilation_events(states: DataFrame, stays: DataFrame) -> DataFrame:
    """State to event: mechanical ventilation before oxygen before extubation."""
    ids = codes.VENT_OUTPUT_ITEMS
    item = (
        F.when(F.col("mech_vent") == 1, ids["mech_vent"])
        .when(F.col("oxygen_therapy") == 1, ids["oxygen_therapy"])
        .when(F.col("extubated") == 1, ids["extubated"])
    )
    return (
        states.withColumn("itemid", item)
        .filter(F.col("itemid").isNotNull())
        .join(stays.select("subject_id", "hadm_id", "icustay_id"), "icustay_id")
        .select(
            F.col("subject_id").alias("SUBJECT_ID"),
            F.col("hadm_id").alias("HADM_ID"),
            F.col("icustay_id").alias("ICUSTAY_ID"),
            F.col("charttime").alias("CHARTTIME"),
            F.col("itemid").alias("ITEMID"),
            F.lit(1).alias("VALUE"),
            F.lit("binary").alias("VALUEUOM"),
        )
    )

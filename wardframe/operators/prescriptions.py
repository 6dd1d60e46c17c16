"""Prescriptions: dose ranges, drug names to items, unit pairs, dose in mg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.functions.text import first_present, split_token, to_number
from wardframe.functions.units import dose_in_mg
from wardframe.operators.cohort import of_cohort
from wardframe.sources import codes


def drug_dictionary(spark: SparkSession) -> DataFrame:
    """(drug, itemid): a fixed list of under 200 names, so broadcasting it is safe."""
    rows = {name: item for item, names in reversed(codes.DRUG_NAMES.items()) for name in names}
    return spark.createDataFrame(list(rows.items()), "drug_key string, itemid int")


def upper_dose(dose: Column) -> Column:
    """``'5-10'`` means up to 10; a single dose stays."""
    return F.when(dose.isNotNull(), first_present(split_token(dose, "-", 2), dose))


def dose_ranges(prescriptions: DataFrame, stays: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Prescriptions within a stay, with its start and the upper dose."""
    return (
        of_cohort(prescriptions, cohort)
        .join(stays.select("icustay_id", "intime"), "icustay_id")
        .withColumn("final_dosis", upper_dose(F.col("dose_val_rx")))
    )


def unit_survey(prescriptions: DataFrame) -> DataFrame:
    """In which units the drugs of interest are prescribed, and how often."""
    spark = prescriptions.sparkSession
    extra = spark.createDataFrame([(n,) for n in codes.SURVEY_ONLY_NAMES], "drug_key string")
    names = F.broadcast(drug_dictionary(spark).select("drug_key").union(extra))
    return (
        prescriptions.withColumn("drug_key", F.lower("drug"))
        .join(names, "drug_key", "left_semi")
        .groupBy("drug_key", F.lower("dose_unit_rx").alias("unit"))
        .agg(F.count(F.lit(1)).alias("prescriptions"))
        .withColumnRenamed("drug_key", "drug")
    )


def accepted_pair() -> Column:
    item, unit = F.col("itemid"), F.lower("dose_unit_rx")
    return (item.isin(*codes.RX_MG_ITEMS) & (unit == "mg")) | (
        item.isin(*codes.RX_UNIT_ITEMS) & (unit == "unit")
    )


def drug_items(doses: DataFrame) -> DataFrame:
    """Drug names to item ids; only doses in the unit expected for the item."""
    names = F.broadcast(drug_dictionary(doses.sparkSession))
    return (
        doses.filter(F.col("final_dosis").isNotNull())
        .withColumn("drug_key", F.lower("drug"))
        .join(names, "drug_key")
        .filter(accepted_pair())
        .withColumn("doses_administered", F.replace("final_dosis", F.lit(","), F.lit("")))
        .drop("drug_key")
    )


def typed_doses(items: DataFrame) -> DataFrame:
    """Dose as a number; a dose of ``'0'`` or junk is no dose."""
    dose = F.col("doses_administered")
    return items.select(
        F.col("subject_id").alias("SUBJECT_ID"),
        F.col("hadm_id").alias("HADM_ID"),
        F.col("icustay_id").alias("ICUSTAY_ID"),
        F.col("startdate").alias("CHARTTIME"),
        F.col("enddate").alias("ENDDATE"),
        F.col("drug_type").alias("DRUG_TYPE"),
        F.col("itemid").alias("ITEMID"),
        F.lower("drug").alias("DRUG"),
        F.col("drug_name_poe").alias("DRUG_NAME_POE"),
        F.col("drug_name_generic").alias("DRUG_NAME_GENERIC"),
        F.col("prod_strength").alias("PROD_STRENGTH"),
        F.when(dose != "0", to_number(dose)).alias("VALUE"),
        F.col("dose_unit_rx").alias("VALUEUOM"),
        F.col("form_val_disp").alias("FORM_VAL_DISP"),
        F.col("form_unit_disp").alias("FORM_UNIT_DISP"),
        F.col("intime").alias("INTIME"),
    )


def doses_in_mg(doses: DataFrame) -> DataFrame:
    """Every dose in mg; units without a rule and zero doses are left out."""
    unit = F.lower("VALUEUOM")
    label = F.when(unit.isin("unit", "ml"), F.lit("mg")).when(unit == "mg", F.col("VALUEUOM"))
    return (
        doses.withColumn("VALUE", dose_in_mg(F.col("ITEMID"), F.col("VALUEUOM"), F.col("VALUE")))
        .withColumn("VALUEUOM", label)
        .filter(F.col("VALUE") != 0)
    )

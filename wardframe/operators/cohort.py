"""Cohort selection and the tables restricted to a cohort."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.sources import codes


def select_cohort(diagnoses: DataFrame, icd9: Iterable[str], seq_num: str = "1") -> DataFrame:
    """Distinct subjects whose primary diagnosis is one of the codes."""
    return (
        diagnoses.filter((F.col("seq_num") == seq_num) & F.col("icd9_code").isin(*icd9))
        .select("subject_id")
        .distinct()
    )


def stemi_cohort(diagnoses: DataFrame) -> DataFrame:
    return select_cohort(diagnoses, codes.STEMI_ICD9)


def nstemi_cohort(diagnoses: DataFrame) -> DataFrame:
    return select_cohort(diagnoses, codes.NSTEMI_ICD9)


def of_cohort(df: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Keep rows of cohort subjects; no cohort means everyone.

    A semi join cannot multiply rows. Whether the cohort is broadcast is left to its
    measured size at run time: a cohort grows with the data.
    """
    if cohort is None:
        return df
    return df.join(cohort.select("subject_id"), "subject_id", "left_semi")


def cohort_sizes(diagnoses: DataFrame, lists: dict[str, Iterable[str]]) -> DataFrame:
    """Distinct subjects per named code list, in one pass over the diagnoses."""
    member = F.array_compact(
        F.array(*[F.when(F.col("icd9_code").isin(*c), F.lit(n)) for n, c in lists.items()])
    )
    return (
        diagnoses.filter(F.col("seq_num") == "1")
        .select("subject_id", F.explode(member).alias("cohort"))
        .groupBy("cohort")
        .agg(F.countDistinct("subject_id").alias("patients"))
    )


def admissions(table: DataFrame, cohort: DataFrame | None) -> DataFrame:
    wanted = (
        "subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "admission_type",
        "admission_location", "discharge_location", "diagnosis",
    )
    out = of_cohort(table, cohort)
    return out.select(*[F.col(c).alias(c.upper()) for c in wanted], "hospital_expire_flag")


def patients(table: DataFrame, cohort: DataFrame | None) -> DataFrame:
    wanted = ("subject_id", "gender", "dob", "dod", "dod_hosp", "dod_ssn", "expire_flag")
    return of_cohort(table, cohort).select(*[F.col(c).alias(c.upper()) for c in wanted])


def icu_stays(table: DataFrame, cohort: DataFrame | None) -> DataFrame:
    wanted = (
        "subject_id", "hadm_id", "icustay_id", "dbsource", "first_careunit", "last_careunit",
        "first_wardid", "last_wardid", "intime", "outtime", "los",
    )
    return of_cohort(table, cohort).select(*[F.col(c).alias(c.upper()) for c in wanted])


def diagnosis_codes(diagnoses: DataFrame, cohort: DataFrame | None) -> DataFrame:
    return of_cohort(diagnoses, cohort).filter(F.col("icd9_code").isNotNull()).select(
        "subject_id", "hadm_id", "icd9_code", "seq_num"
    )


def procedure_codes(procedures: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Procedures of interest, relabelled with a leading "P"."""
    picked = procedures.filter(F.col("icd9_code").isin(*codes.PROCEDURE_ICD9))
    return of_cohort(picked, cohort).select(
        "subject_id", "hadm_id", F.concat(F.lit("P"), "icd9_code").alias("final_itemid"), "seq_num"
    )


def diagnoses_and_procedures(
    diagnoses: DataFrame, procedures: DataFrame, cohort: DataFrame | None
) -> DataFrame:
    """Both code systems in one column, duplicates removed once after the union."""
    return (
        diagnosis_codes(diagnoses, cohort)
        .unionByName(procedure_codes(procedures, cohort).withColumnRenamed("final_itemid", "icd9_code"))
        .distinct()
    )

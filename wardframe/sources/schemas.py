"""Explicit schemas of every input table; nothing is inferred."""

from __future__ import annotations

# Timestamps carry no zone in the source data.
TABLES = {
    "patients": "subject_id long, gender string, dob timestamp_ntz, dod timestamp_ntz, "
    "dod_hosp timestamp_ntz, dod_ssn timestamp_ntz, expire_flag int",
    "admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, "
    "dischtime timestamp_ntz, deathtime timestamp_ntz, admission_type string, "
    "admission_location string, discharge_location string, diagnosis string, "
    "hospital_expire_flag int",
    "icustays": "subject_id long, hadm_id long, icustay_id long, dbsource string, "
    "first_careunit string, last_careunit string, first_wardid int, last_wardid int, "
    "intime timestamp_ntz, outtime timestamp_ntz, los double",
    "diagnoses_icd": "subject_id long, hadm_id long, icd9_code string, seq_num string",
    "procedures_icd": "subject_id long, hadm_id long, icd9_code string, seq_num string",
    "chartevents": "subject_id long, hadm_id long, icustay_id long, itemid int, "
    "charttime timestamp_ntz, storetime timestamp_ntz, value string, valuenum double, "
    "valueuom string, warning int, error int, resultstatus string, stopped string",
    "labevents": "subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, "
    "value string, valuenum double, valueuom string",
    "procedureevents_mv": "icustay_id long, starttime timestamp_ntz, itemid int",
    "inputevents_cv": "subject_id long, hadm_id long, icustay_id long, "
    "charttime timestamp_ntz, itemid int, amount double, amountuom string",
    "inputevents_mv": "subject_id long, hadm_id long, icustay_id long, "
    "starttime timestamp_ntz, itemid int, amount double, amountuom string, "
    "statusdescription string",
    "outputevents": "subject_id long, hadm_id long, icustay_id long, "
    "charttime timestamp_ntz, itemid int, value double, valueuom string, iserror int",
    "prescriptions": "subject_id long, hadm_id long, icustay_id long, "
    "startdate timestamp_ntz, enddate timestamp_ntz, drug_type string, drug string, "
    "drug_name_poe string, drug_name_generic string, prod_strength string, "
    "dose_val_rx string, dose_unit_rx string, form_val_disp string, form_unit_disp string",
    "noteevents": "subject_id long, hadm_id long, chartdate timestamp_ntz, category string, "
    "description string, text string, iserror string",
    "d_items": "itemid int, label string, dbsource string, linksto string",
}

EVENT = (
    "SUBJECT_ID long, HADM_ID long, CHARTDATE timestamp_ntz, CHARTTIME timestamp_ntz, "
    "ITEMID int, VALUE double, VALUEUOM string"
)
EVENT_COLUMNS = (
    "SUBJECT_ID", "HADM_ID", "CHARTDATE", "CHARTTIME", "ITEMID", "VALUE", "VALUEUOM",
)
DEMOGRAPHICS = (
    "PID long, GENDER string, AGE double, `Diabetes mellitus` int, Hypertension int, "
    "`Cardiac dysrhythmias` int, `Cardiac arrest and ventricular fibrillation` int, "
    "ICU string, MORTALITY_INUNIT int"
)
PREDICTION = "pid long, step int, feature string, y double, yhat double, observed boolean"


def series_schema(features: tuple[str, ...], kind: str = "double", saved_index: bool = True) -> str:
    """Schema of a series or mask CSV: saved index column, pid, then the features."""
    head = "_c0 long, pid long" if saved_index else "pid long"
    return head + "".join(f", `{name}` {kind}" for name in features)

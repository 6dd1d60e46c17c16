"""Cohorts, structured events, prescriptions, first-day labs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardframe.operators import cohort as co
from wardframe.operators import events as ev
from wardframe.operators import items, labs, prescriptions, relations, ventilation
from wardframe.plans.inputs import source, spark_view
from wardframe.plans.registry import listed, query, with_views
from wardframe.sources import codes

STEMI = (
    "SELECT DISTINCT subject_id FROM diagnoses_icd "
    f"WHERE seq_num = '1' AND icd9_code IN ({listed(codes.STEMI_ICD9)})"
)
NSTEMI = (
    "SELECT DISTINCT subject_id FROM diagnoses_icd "
    f"WHERE seq_num = '1' AND icd9_code IN ({listed(codes.NSTEMI_ICD9)})"
)
IN_COHORT = "subject_id IN (SELECT subject_id FROM cohort)"


def stemi(spark, sf):
    return co.stemi_cohort(spark_view(spark, sf, "diagnoses_icd"))


@query("cohort_select", with_views("diagnoses_icd") + STEMI)
def cohort_select(spark, sf):
    return stemi(spark, sf)


@query("cohort_select_nstemi", with_views("diagnoses_icd") + NSTEMI)
def cohort_select_nstemi(spark, sf):
    return co.nstemi_cohort(spark_view(spark, sf, "diagnoses_icd"))


@query("cohort_sizes", with_views("diagnoses_icd", a=STEMI, b=NSTEMI)
       + "SELECT 'stemi' AS cohort, count(*) AS patients FROM a UNION ALL SELECT 'nstemi', count(*) FROM b")
def cohort_sizes(spark, sf):
    lists = {"stemi": codes.STEMI_ICD9, "nstemi": codes.NSTEMI_ICD9}
    return co.cohort_sizes(spark_view(spark, sf, "diagnoses_icd"), lists)


@query("cohort_admissions", with_views("diagnoses_icd", "admissions", cohort=STEMI) + f"""
    SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, admittime AS ADMITTIME, dischtime AS DISCHTIME,
           deathtime AS DEATHTIME, admission_type AS ADMISSION_TYPE, admission_location AS ADMISSION_LOCATION,
           discharge_location AS DISCHARGE_LOCATION, diagnosis AS DIAGNOSIS, hospital_expire_flag
    FROM admissions WHERE {IN_COHORT}""")
def cohort_admissions(spark, sf):
    return co.admissions(spark_view(spark, sf, "admissions"), stemi(spark, sf))


@query("cohort_patients", with_views("diagnoses_icd", "patients", cohort=STEMI) + f"""
    SELECT subject_id AS SUBJECT_ID, gender AS GENDER, dob AS DOB, dod AS DOD, dod_hosp AS DOD_HOSP,
           dod_ssn AS DOD_SSN, expire_flag AS EXPIRE_FLAG
    FROM patients WHERE {IN_COHORT}""")
def cohort_patients(spark, sf):
    return co.patients(spark_view(spark, sf, "patients"), stemi(spark, sf))


@query("cohort_icustays", with_views("diagnoses_icd", "icustays", cohort=STEMI) + f"""
    SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, icustay_id AS ICUSTAY_ID, dbsource AS DBSOURCE,
           first_careunit AS FIRST_CAREUNIT, last_careunit AS LAST_CAREUNIT, first_wardid AS FIRST_WARDID,
           last_wardid AS LAST_WARDID, intime AS INTIME, outtime AS OUTTIME, los AS LOS
    FROM icustays WHERE {IN_COHORT}""")
def cohort_icustays(spark, sf):
    return co.icu_stays(spark_view(spark, sf, "icustays"), stemi(spark, sf))


@query("cohort_diagnoses", with_views("diagnoses_icd", cohort=STEMI) + f"""
    SELECT subject_id, hadm_id, icd9_code, seq_num FROM diagnoses_icd
    WHERE icd9_code IS NOT NULL AND {IN_COHORT}""")
def cohort_diagnoses(spark, sf):
    return co.diagnosis_codes(spark_view(spark, sf, "diagnoses_icd"), stemi(spark, sf))


PROCEDURES = f"""
    SELECT subject_id, hadm_id, 'P' || icd9_code AS final_itemid, seq_num FROM procedures_icd
    WHERE icd9_code IN ({listed(codes.PROCEDURE_ICD9)}) AND {IN_COHORT}"""


@query("cohort_procedures", with_views("diagnoses_icd", "procedures_icd", cohort=STEMI) + PROCEDURES)
def cohort_procedures(spark, sf):
    return co.procedure_codes(spark_view(spark, sf, "procedures_icd"), stemi(spark, sf))


@query("dx_union_procedures", with_views("diagnoses_icd", "procedures_icd", cohort=STEMI) + f"""
    SELECT subject_id, hadm_id, icd9_code, seq_num FROM diagnoses_icd WHERE {IN_COHORT}
    UNION SELECT * FROM ({PROCEDURES})""")
def dx_union_procedures(spark, sf):
    dx, proc = (spark_view(spark, sf, v) for v in ("diagnoses_icd", "procedures_icd"))
    return co.diagnoses_and_procedures(dx, proc, co.stemi_cohort(dx))


def _rounded(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28, 6)), 2) AS DOUBLE)"


_MEASURE = """CASE WHEN itemid IN (678, 679, 223761) AND valuenum > 50 THEN (valuenum - 32) * 5 / 9
    WHEN itemid = 226707 AND valuenum < 100 THEN valuenum * 2.54::DOUBLE ELSE valuenum END"""


@query("chart_unit_convert", with_views("diagnoses_icd", "chartevents", cohort=STEMI) + f"""
    SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, icustay_id AS ICUSTAY_ID, itemid AS ITEMID,
           charttime AS CHARTTIME, storetime AS STORETIME, {_rounded(_MEASURE)} AS VALUE,
           CASE lower(valueuom) WHEN 'inch' THEN 'cm' WHEN 'deg. f' THEN 'Deg. C' WHEN '?f' THEN 'Deg. C'
                ELSE valueuom END AS VALUEUOM,
           warning AS WARNING, resultstatus AS RESULTSTATUS, stopped AS STOPPED
    FROM chartevents WHERE (error IS NULL OR error = 0) AND valuenum > 0 AND {IN_COHORT}""")
def chart_unit_convert(spark, sf):
    return ev.chart_events(spark_view(spark, sf, "chartevents"), stemi(spark, sf))


@query("lab_unit_convert", with_views("labevents_plain") + f"""
    SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, itemid AS ITEMID, charttime AS CHARTTIME,
           {_rounded(_MEASURE)} AS VALUE,
           CASE lower(valueuom) WHEN 'inch' THEN 'cm' WHEN 'deg. f' THEN 'Deg. C' ELSE valueuom END AS VALUEUOM
    FROM labevents_plain WHERE valuenum > 0""")
def lab_unit_convert(spark, sf):
    return ev.lab_events(spark_view(spark, sf, "labevents_plain"), None)


def _inputs_sql(time: str, unit: str, extra: str) -> str:
    return with_views("inputevents") + f"""
    SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, icustay_id AS ICUSTAY_ID, {time} AS CHARTTIME,
           itemid AS ITEMID, {_rounded('amount')} AS VALUE, amountuom AS VALUEUOM
    FROM inputevents WHERE amount > 0 AND itemid IN ({listed(codes.INPUT_ITEMS)}) {extra}
      AND ((itemid IN ({listed(codes.INPUT_MG_ITEMS)}) AND lower(amountuom) = 'mg')
        OR (itemid IN ({listed(codes.INPUT_UNIT_ITEMS)}) AND lower(amountuom) = '{unit}'))"""


@query("input_events_cv", _inputs_sql("charttime", "u", ""))
def input_events_cv(spark, sf):
    return ev.input_events_cv(spark_view(spark, sf, "inputevents"), None)


@query("input_events_mv", _inputs_sql("starttime", "units", "AND statusdescription <> 'Rewritten'"))
def input_events_mv(spark, sf):
    return ev.input_events_mv(spark_view(spark, sf, "inputevents"), None)


@query("output_events", with_views("outputevents") + """
    SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, icustay_id AS ICUSTAY_ID, charttime AS CHARTTIME,
           itemid AS ITEMID, value AS VALUE, valueuom AS VALUEUOM, CAST(coalesce(iserror, 0) AS INT) AS iserror
    FROM outputevents WHERE value > 0""")
def output_events(spark, sf):
    out = ev.output_events(spark_view(spark, sf, "outputevents"), None)
    return out.withColumn("iserror", F.coalesce("iserror", F.lit(0)))


_VENT = f"""
    SELECT icustay_id, charttime,
      max(CASE WHEN (itemid = 720 AND value <> 'Other/Remarks') OR (itemid = 223848 AND value <> 'Other')
           OR itemid = 223849 OR (itemid = 467 AND value = 'Ventilator')
           OR itemid IN ({listed(codes.VENT_SETTING_ITEMS)}) THEN 1 ELSE 0 END) AS mech_vent,
      max(CASE WHEN (itemid = 226732 AND value IN ({listed(codes.O2_DEVICES_MV)}))
           OR (itemid = 467 AND value IN ({listed(codes.O2_DEVICES_CV)})) THEN 1 ELSE 0 END) AS oxygen_therapy,
      max(CASE WHEN itemid = 640 AND value IN ('Extubated', 'Self Extubation') THEN 1 ELSE 0 END) AS extubated,
      max(CASE WHEN itemid = 640 AND value = 'Self Extubation' THEN 1 ELSE 0 END) AS self_extubated
    FROM vent_chartevents
    WHERE value IS NOT NULL AND (error <> 1 OR error IS NULL)
      AND itemid IN (720, 223849, 223848, 640, 468, 469, 470, 471, 227287, 226732, 223834, 467,
                     {listed(codes.VENT_SETTING_ITEMS)})
    GROUP BY icustay_id, charttime
    UNION
    SELECT icustay_id, starttime, 0, 0, 1, CASE WHEN itemid = 225468 THEN 1 ELSE 0 END
    FROM vent_procedures WHERE itemid IN (227194, 225468, 225477)"""


def _ventilation(spark, sf):
    return ventilation.ventilation_state(
        spark_view(spark, sf, "vent_chartevents"), spark_view(spark, sf, "vent_procedures")
    )


@query("vent_state", with_views("vent_chartevents", "vent_procedures") + _VENT)
def vent_state(spark, sf):
    return _ventilation(spark, sf)


@query("vent_events", with_views("vent_chartevents", "vent_procedures", "event_stays", vent=_VENT) + """
    SELECT s.subject_id AS SUBJECT_ID, s.hadm_id AS HADM_ID, v.icustay_id AS ICUSTAY_ID,
           v.charttime AS CHARTTIME,
           CASE WHEN mech_vent = 1 THEN 226260 WHEN oxygen_therapy = 1 THEN 226732 ELSE 227194 END AS ITEMID,
           1 AS VALUE, 'binary' AS VALUEUOM
    FROM vent v JOIN event_stays s ON v.icustay_id = s.icustay_id
    WHERE mech_vent = 1 OR oxygen_therapy = 1 OR extubated = 1""")
def vent_events(spark, sf):
    return ventilation.ventilation_events(_ventilation(spark, sf), spark_view(spark, sf, "event_stays"))


_DRUG_ROWS = {n: i for i, names in reversed(codes.DRUG_NAMES.items()) for n in names}
_DRUGS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {i})" for n, i in _DRUG_ROWS.items()
) + ") AS t(drug_key, itemid)"
_DOSES = """
    SELECT p.*, i.intime, CASE WHEN split_part(dose_val_rx, '-', 2) = '' THEN dose_val_rx
           ELSE split_part(dose_val_rx, '-', 2) END AS final_dosis
    FROM prescriptions p JOIN icustays i ON p.icustay_id = i.icustay_id"""
_ITEMS = f"""
    SELECT d.*, n.itemid, replace(final_dosis, ',', '') AS doses_administered
    FROM doses d JOIN drugs n ON lower(d.drug) = n.drug_key
    WHERE final_dosis IS NOT NULL
      AND ((itemid IN ({listed(codes.RX_MG_ITEMS)}) AND lower(dose_unit_rx) = 'mg')
        OR (itemid IN ({listed(codes.RX_UNIT_ITEMS)}) AND lower(dose_unit_rx) = 'unit'))"""
_TYPED = """
    SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, icustay_id AS ICUSTAY_ID, startdate AS CHARTTIME,
           itemid AS ITEMID, lower(drug) AS DRUG,
           CASE WHEN doses_administered <> '0' THEN try_cast(doses_administered AS DOUBLE) END AS VALUE,
           dose_unit_rx AS VALUEUOM, intime AS INTIME
    FROM items"""
_RX_VIEWS = ("prescriptions", "icustays")


def _doses(spark, sf):
    return prescriptions.dose_ranges(*(spark_view(spark, sf, v) for v in _RX_VIEWS))


@query("dose_range_parse", with_views(*_RX_VIEWS, doses=_DOSES) + """
    SELECT icustay_id, line, part, drug, dose_val_rx, dose_unit_rx, intime, final_dosis FROM doses""")
def dose_range_parse(spark, sf):
    return _doses(spark, sf).select(
        "icustay_id", "line", "part", "drug", "dose_val_rx", "dose_unit_rx", "intime", "final_dosis"
    )


@query("drug_unit_survey", with_views("prescriptions", drugs=_DRUGS) + f"""
    SELECT lower(drug) AS drug, lower(dose_unit_rx) AS unit, count(*) AS prescriptions
    FROM prescriptions WHERE lower(drug) IN (SELECT drug_key FROM drugs)
       OR lower(drug) IN ({listed(codes.SURVEY_ONLY_NAMES)}) GROUP BY 1, 2""")
def drug_unit_survey(spark, sf):
    return prescriptions.unit_survey(spark_view(spark, sf, "prescriptions"))


@query("prescription_items", with_views(*_RX_VIEWS, drugs=_DRUGS, doses=_DOSES, items=_ITEMS) + """
    SELECT icustay_id, line, part, drug, itemid, dose_unit_rx, doses_administered FROM items""")
def prescription_items(spark, sf):
    return prescriptions.drug_items(_doses(spark, sf)).select(
        "icustay_id", "line", "part", "drug", "itemid", "dose_unit_rx", "doses_administered"
    )


_TYPED_COLUMNS = (
    "SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "CHARTTIME", "ITEMID", "DRUG", "VALUE", "VALUEUOM", "INTIME",
)


@query("prescription_doses", with_views(*_RX_VIEWS, drugs=_DRUGS, doses=_DOSES, items=_ITEMS) + _TYPED)
def prescription_doses(spark, sf):
    return prescriptions.typed_doses(prescriptions.drug_items(_doses(spark, sf))).select(*_TYPED_COLUMNS)


@query("dose_to_mg", with_views(*_RX_VIEWS, drugs=_DRUGS, doses=_DOSES, items=_ITEMS, typed=_TYPED, mg="""
    SELECT * REPLACE (
      CASE WHEN lower(VALUEUOM) = 'unit' AND ITEMID = 30025 THEN VALUE * 0.0071::DOUBLE
           WHEN lower(VALUEUOM) = 'unit' AND ITEMID IN (4475, 223260) THEN VALUE * 0.0347::DOUBLE
           WHEN lower(VALUEUOM) IN ('ml', 'mg') THEN VALUE END AS VALUE,
      CASE WHEN lower(VALUEUOM) IN ('unit', 'ml') THEN 'mg' WHEN lower(VALUEUOM) = 'mg' THEN VALUEUOM END AS VALUEUOM)
    FROM typed""") + "SELECT * REPLACE (round(VALUE, 6) AS VALUE) FROM mg WHERE VALUE <> 0")
def dose_to_mg(spark, sf):
    typed = prescriptions.typed_doses(prescriptions.drug_items(_doses(spark, sf)))
    return prescriptions.doses_in_mg(typed).select(*_TYPED_COLUMNS).withColumn("VALUE", F.round("VALUE", 6))


_LIMITS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{label}', {top})" for i, label, top in codes.FIRST_DAY_LABS
) + ") AS t(itemid, label, upper_limit)"


@query("first_lab", with_views("icustays", "labevents", "admissions", "diagnoses_icd", cohort=STEMI, limits=_LIMITS, pvt="""
    SELECT ie.subject_id, ie.hadm_id, ie.icustay_id, le.charttime, le.label,
           CASE WHEN le.valuenum <= le.upper_limit THEN le.valuenum END AS valuenum,
           CASE WHEN ad.deathtime BETWEEN ie.intime AND ie.outtime THEN 1 ELSE 0 END AS mort_icu,
           CASE WHEN ad.deathtime BETWEEN ad.admittime AND ad.dischtime THEN 1 ELSE 0 END AS mort_hosp
    FROM icustays ie
    LEFT JOIN (SELECT * FROM labevents JOIN limits USING (itemid) WHERE valuenum > 0) le
      ON le.subject_id = ie.subject_id AND le.hadm_id = ie.hadm_id
     AND le.charttime BETWEEN ie.intime - INTERVAL '6' HOUR AND ie.intime + INTERVAL '1' DAY
    LEFT JOIN admissions ad ON ie.subject_id = ad.subject_id AND ie.hadm_id = ad.hadm_id""", ranked="""
    SELECT *, dense_rank() OVER (PARTITION BY subject_id, hadm_id, icustay_id, label ORDER BY charttime) AS drank
    FROM pvt""") + "SELECT subject_id, hadm_id, icustay_id, mort_icu, mort_hosp, " + ", ".join(
    f"max(CASE WHEN label = '{label}' THEN valuenum END) AS \"{label.replace(' ', '')}_1st\"" for label in codes.LAB_LABELS
) + " FROM ranked WHERE drank = 1 AND " + IN_COHORT + " GROUP BY 1, 2, 3, 4, 5")
def first_lab(spark, sf):
    return labs.first_day_labs(
        *(spark_view(spark, sf, v) for v in ("icustays", "labevents", "admissions")), stemi(spark, sf)
    )


_TERMS = "SELECT unnest([" + listed(codes.DISCOVERY_TERMS) + "]) AS term"


@query("item_discovery", with_views("d_items", terms=_TERMS) + """
    SELECT itemid, label, dbsource, linksto, term FROM d_items JOIN terms ON contains(lower(label), term)""")
def item_discovery(spark, sf):
    return items.discover_items(spark_view(spark, sf, "d_items"))


@query("update_insert_union", """
    WITH first_copy AS (SELECT user_id, event_type, value, ts FROM events),
    second_copy AS (SELECT user_id, event_type, CASE WHEN event_type = 'click' THEN 100.0 ELSE value END AS value, ts
                    FROM events
                    UNION ALL SELECT 24, 'inserted', 200.0, TIMESTAMP '2139-06-09 00:00:00')
    SELECT * FROM first_copy UNION SELECT * FROM second_copy""")
def update_insert_union(spark, sf):
    import datetime

    rows = source(spark, sf, "events").select("user_id", "event_type", "value", "ts")
    changed = relations.update_where(rows, F.col("event_type") == "click", value=100.0)
    changed = relations.insert_rows(changed, [(24, "inserted", 200.0, datetime.datetime(2139, 6, 9))])
    return relations.union_distinct(rows, changed)

"""The supplied tables seen as clinical tables.

Each view is one SQL text that both Spark and DuckDB understand: ``{events}`` etc. stand
for the supplied tables, ``{ntz}`` for the zone-less timestamp type. A view covers every
row of its source table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
EVENT_TYPES = ("view", "signup", "error", "click", "purchase")


def _pick(values: str, index: str) -> str:
    """The ``index``-th (0-based) of comma-separated texts, in any SQL dialect."""
    n = len(values.split(","))
    return f"split_part('{values}', ',', CAST({index} % {n} + 1 AS INT))"


def _number(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


_LAB_ITEMS = (
    "50868,50862,50882,50885,50912,50806,50902,50809,50931,50810,51221,50811,51222,50813,"
    "50960,50970,51265,50822,50971,51275,51237,51274,50824,50983,51006,51300,51301,50804"
)
_VENT_ITEMS = "720,223848,223849,467,226732,640,445,468,226732,467,999,640"
_VENT_VALUES = (
    "Other/Remarks,Drager,Other,Ventilator,Nasal Cannula,Trach mask ,Extubated,Self Extubation,"
    "Nasal cannula,Face Tent,12"
)
_DRUGS = (
    "Aspirin,Clopidogrel,LISINOPRIL,Heparin,Insulin,Metoprolol Tartrate,Amiodarone,"
    "Unknown Drug,Atorvastatin,Lantus,Digoxin,Captopril,Heparin Flush (10 units/ml),Warfarin,"
    "Rosuvastatin,Crestor,Rosuvastatin Calcium,Ezallor,Bisoprolol,Concor,Ziac,Maxsoten,Bezafibrate,Cedur,Low-Molecular-Weight"
)
_LABELS = "Heparin Sodium,Aspirin EC,Heart Rate,Toprol XL,Insulin - Regular,Sodium,DILTIAZEM,Amiodarone HCl"

_A = _number("n_chars % 90 + 10")      # two digits
_B = _number("n_chars % 7 + 1")        # one digit
_C = _number("doc_id % 12 + 1")        # month
_D = _number("doc_id % 28 + 1")        # day
_H = _number("doc_id % 14 + 10")       # hour, two digits
_M = _number("n_chars % 50 + 10")      # minute, two digits
_DAY = f"'[**2100-' || {_C} || '-' || {_D} || '**]'"
_CLOCK = f"{_H} || ':' || {_M}"
_NL = "chr(10)"

# Phrases in the style of each note category, filled with numbers of the document row.
_PHRASES = {
    "Echo": f"'Date/Time: ' || {_DAY} || ' at ' || {_CLOCK} || {_NL} || 'Height: (in) ' || {_A} || {_NL}"
    f" || 'Weight (lb): ' || {_A} || '0' || {_NL} || 'BP (mm Hg): 1' || {_A} || '/' || {_A} || {_NL}"
    f" || 'HR (bpm): ' || {_A} || {_NL}",
    "General": f"'Flowsheet Data as of  ' || {_DAY} || ' ' || {_CLOCK} || {_NL} || 'Insulin - Regular - ' || {_B}"
    f" || ' units/hour' || {_NL} || 'Heparin Sodium - 1,0' || {_A} || CASE WHEN doc_id % 3 = 0 THEN ' units/hour' ELSE ' mL/hour' END"
    f" || {_NL} || 'Amiodarone - 0.' || {_B} || ' mg/min' || {_NL} || 'Troponin-T:2' || {_A} || '/31/0.' || {_A}"
    f" || ' ck-mb ' || {_A} || ' ck 2' || {_A} || '  mb index 3.' || {_B} || {_NL} || 'Lipitor ' || {_A} || ' mg given.'",
    "Consult": f"'Flowsheet Data as of  ' || {_DAY} || ' ' || {_CLOCK} || {_NL} || 'Amiodarone - 1 mg/min' || {_NL}"
    f" || 'troponin 0.' || {_A} || ', ck-mb ' || {_A} || ' then trop <0.' || {_A} || ' and CK- peak 3' || {_A}"
    f" || ' Troponin-T:12/3/0.' || {_A} || '. mb 4.' || {_B} || {_NL} || ' asa ' || {_A} || ' daily'",
    "Physician ": f"'Flowsheet Data as of ' || {_DAY} || ' ' || {_CLOCK} || ' Troponin T <0.' || {_A} || {_NL}"
    f" || 'TropT 0.' || {_A} || ' Troponin-T:51//<0.' || {_A} || ' Troponin T:167/4/0.' || {_A} || ' tropt- >' || {_B} || '.' || {_A}"
    f" || ' CK-MB ' || {_A} || {_NL} || 'started on lisinopril 5mg - given at ' || {_H} || {_M} || ' lisinopril ' || {_A} || ' mg;"
    f" enalapril to ' || {_B} || '; 25 mg metoprolol then toprol xl ' || {_A}",
    "Discharge summary": f"'Pertinent Results: ' || {_DAY} || ' ' || {_CLOCK} || 'pm ck-mb-' || {_A} || ' ' || {_DAY} || ' 1:23a ck(cpk)-1' || {_A}"
    f" || '* ck-mb-' || {_B} || ' ' || {_DAY} || ' ' || {_CLOCK} || ' ck-2' || {_A} || ' ' || {_DAY} || ' ' || {_CLOCK} || 'am ctropnt-0.' || {_A}"
    f" || ' ' || {_DAY} || ' ' || {_CLOCK} || 'am blood ck-mb-' || {_B} || '5 ctropnt-1.' || {_A} || ' mb indx-3.' || {_B}"
    f" || {_NL} || 'trop 0.' || {_A} || ' ' || {_D} || '-' || {_C} || ' ' || {_CLOCK} || ' mb ' || {_A} || ' ck peak ' || {_A} || '1'",
    "Nutrition": f"'Glucose 1' || {_A} || ' mg/dL ' || {_DAY} || ' 0' || {_B} || ':' || {_M} || ' AM' || {_NL}"
    f" || 'Creatinine ' || {_B} || '.' || {_B} || ' mg/dL ' || {_DAY} || ' ' || {_CLOCK} || ' PM PO2 (arterial) ' || {_A} || ' mm Hg ' || {_DAY} || ' 04:12 PM"
    f" Hematocrit 3' || {_B} || '.' || {_B} || ' % ' || {_DAY} || ' ' || {_CLOCK} || {_NL} || 'Glucose Finger Stick 1' || {_A} || ' ' || {_DAY} || ' ' || {_CLOCK}",
    "Nursing": f"'Troponin 0.' || {_A} || {_NL} || 'trop t: 1.' || {_A} || ' CK ' || {_A} || '4 MB 1' || {_B} || ' captopril to ' || {_A} || '.' || {_NL}"
    f" || 'aspirin ' || {_A} || ' given, simvastatin ' || {_A} || ' at ' || {_H} || {_M} || '. simvastatin at ' || {_H} || {_M} || '. atenolol ' || {_A} || '.5'",
    "Nursing/other": f"'trop >' || {_A} || ' and troponin of 0.' || {_A} || {_NL} || 'lopressor ' || {_A} || ' po, crestor ' || {_A} || ' mg. sotalol 8' || {_A}"
    f" || '00 mg, carvedilol ' || {_B} || '.' || {_B} || ' bid. pravachol ' || {_A}",
    "Rehab Services": f"'troponin: 0.' || {_A} || ' trop>' || {_A} || ' ck-mb ' || {_A} || ' troponin peaked  mb 2.' || {_B}",
    "Radiology": "'No acute process.'",
}


def _note_text() -> str:
    cases = " ".join(
        f"WHEN {i} THEN {phrase}" for i, phrase in enumerate(_PHRASES.values())
    )
    return f"text || {_NL} || CASE doc_id % {len(_PHRASES)} {cases} END || {_NL}"


VIEWS = {
    "patients": """
        SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
               CAST('2050-01-01' AS {ntz}) + c_custkey * INTERVAL '1' DAY AS dob,
               CASE WHEN c_acctbal < 0 THEN CAST('2110-01-01' AS {ntz}) END AS dod,
               CAST(NULL AS {ntz}) AS dod_hosp, CAST(NULL AS {ntz}) AS dod_ssn,
               CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS expire_flag
        FROM {customer}""",
    "admissions": """
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
               o_orderdate + INTERVAL '10' DAY AS dischtime,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0
                    THEN o_orderdate + (o_orderkey % 14) * INTERVAL '1' DAY END AS deathtime,
               o_orderpriority AS admission_type, 'EMERGENCY ROOM' AS admission_location,
               o_orderstatus AS discharge_location, CAST(o_totalprice AS STRING) AS diagnosis,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hospital_expire_flag
        FROM {orders}""",
    "icustays": """
        SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey AS icustay_id,
               'metavision' AS dbsource, o_orderpriority AS first_careunit, o_orderstatus AS last_careunit,
               CAST(o_orderkey % 50 AS INT) AS first_wardid, CAST(o_orderkey % 40 AS INT) AS last_wardid,
               o_orderdate + INTERVAL '2' HOUR AS intime, o_orderdate + INTERVAL '5' DAY AS outtime,
               o_totalprice / 100000 AS los
        FROM {orders}""",
    "diagnoses_icd": "SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, "
    + _pick("41001,41071,4280,41011,5849,41091,V4581,25000,4111,41072", "o_orderkey")
    + " AS icd9_code, CAST(o_orderkey % 3 + 1 AS STRING) AS seq_num FROM {orders}",
    "procedures_icd": "SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, "
    + _pick("3615,9604,3893,45,0066,3722,9904,8856", "(o_custkey + o_orderkey)")
    + " AS icd9_code, CAST(o_orderkey % 4 + 1 AS STRING) AS seq_num FROM {orders}",
    "chartevents": """
        SELECT user_id AS subject_id, user_id * 10 AS hadm_id, user_id AS icustay_id,
               CASE event_type WHEN 'view' THEN 678 WHEN 'signup' THEN 226707 WHEN 'error' THEN 211
                    WHEN 'click' THEN 223761 ELSE 8368 END AS itemid,
               ts AS charttime, ts + INTERVAL '1' HOUR AS storetime, CAST(value AS STRING) AS value,
               value - 5 AS valuenum,
               CASE event_type WHEN 'view' THEN 'Deg. F' WHEN 'signup' THEN 'Inch' WHEN 'error' THEN 'bpm'
                    WHEN 'click' THEN '?F' ELSE 'mmHg' END AS valueuom,
               CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS warning,
               CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 3 = 0 THEN NULL ELSE 0 END AS error,
               CAST(NULL AS STRING) AS resultstatus, CAST(NULL AS STRING) AS stopped
        FROM {events}""",
    "labevents_plain": """
        SELECT user_id AS subject_id, user_id * 10 AS hadm_id,
               CASE event_type WHEN 'view' THEN 679 WHEN 'signup' THEN 226707 ELSE 50912 END AS itemid,
               ts AS charttime, CAST(value AS STRING) AS value, value - 3 AS valuenum,
               CASE event_type WHEN 'view' THEN 'deg. F' WHEN 'signup' THEN 'inch' WHEN 'click' THEN '?F'
                    ELSE 'mg/dL' END AS valueuom
        FROM {events}""",
    "vent_chartevents": "SELECT user_id AS subject_id, user_id AS icustay_id, CAST("
    + _pick(_VENT_ITEMS, "event_id")
    + " AS INT) AS itemid, CAST(date_trunc('HOUR', ts) AS {ntz}) AS charttime, CASE WHEN event_id % 13 = 0 THEN NULL ELSE "
    + _pick(_VENT_VALUES, "event_id")
    + " END AS value, CASE WHEN event_id % 17 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 0 ELSE NULL END AS error FROM {events}",
    "vent_procedures": "SELECT user_id AS icustay_id, CAST(date_trunc('HOUR', ts) AS {ntz}) AS starttime, CAST("
    + _pick("227194,225468,225477,999", "event_id")
    + " AS INT) AS itemid FROM {events}",
    "event_stays": """
        SELECT user_id AS subject_id, user_id * 10 AS hadm_id, user_id AS icustay_id, user_id AS pid,
               min(ts) AS intime, max(ts) AS outtime
        FROM {events} GROUP BY user_id""",
    "inputevents": "SELECT l_suppkey AS subject_id, l_orderkey AS hadm_id, l_orderkey AS icustay_id, "
    "l_shipdate AS charttime, l_shipdate AS starttime, CAST("
    + _pick("30112,30025,30045,221261,99999,30134,223258,30042", "l_partkey")
    + " AS INT) AS itemid, l_quantity - 3 + l_tax / 7 AS amount, "
    + _pick("mg,U,units,MG", "l_linenumber")
    + " AS amountuom, CASE l_returnflag WHEN 'R' THEN 'Rewritten' WHEN 'A' THEN NULL ELSE 'FinishedRunning' END"
    " AS statusdescription FROM {lineitem}",
    "outputevents": """
        SELECT user_id AS subject_id, user_id * 10 AS hadm_id, user_id AS icustay_id, ts AS charttime,
               CAST(event_id % 9 + 40055 AS INT) AS itemid, value - 10 AS value, 'ml' AS valueuom,
               CASE WHEN event_id % 7 = 0 THEN 1 END AS iserror
        FROM {events}""",
    "prescriptions": "SELECT l_suppkey AS subject_id, l_orderkey AS hadm_id, l_orderkey AS icustay_id, l_linenumber AS line, "
    "l_partkey AS part, l_shipdate AS startdate, l_shipdate + INTERVAL '3' DAY AS enddate, 'MAIN' AS drug_type, "
    + _pick(_DRUGS, "l_partkey")
    + " AS drug, CAST(NULL AS STRING) AS drug_name_poe, CAST(NULL AS STRING) AS drug_name_generic, "
    "l_returnflag AS prod_strength, CASE l_linenumber WHEN 1 THEN '5-' || CAST(CAST(l_quantity AS INT) AS STRING) "
    "WHEN 2 THEN '1,' || CAST(CAST(l_quantity AS INT) + 100 AS STRING) WHEN 3 THEN '0' WHEN 4 THEN 'regular0' "
    "WHEN 5 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) || '.5' END AS dose_val_rx, "
    + _pick("mg,UNIT,ml,mcg,MG", "(l_partkey + l_suppkey)")
    + " AS dose_unit_rx, '1' AS form_val_disp, 'TAB' AS form_unit_disp FROM {lineitem}",
    "labevents": "SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, CAST("
    + _pick(_LAB_ITEMS, "l_partkey")
    + " AS INT) AS itemid, o_orderdate + (l_suppkey % 48 - 8) * INTERVAL '1' HOUR AS charttime, "
    "l_quantity * l_linenumber - 2 AS valuenum FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "d_items": "SELECT p_partkey AS itemid, p_name || ' ' || " + _pick(_LABELS, "p_size")
    + " AS label, p_brand AS dbsource, p_type AS linksto FROM {part}",
    "noteevents": "SELECT doc_id AS subject_id, doc_id * 3 AS hadm_id, "
    "CAST('2100-01-01' AS {ntz}) + (doc_id % 300) * INTERVAL '1' DAY AS chartdate, "
    + _pick(",".join(_PHRASES), "doc_id")
    + " AS category, source AS description, CASE WHEN n_chars % 29 = 0 THEN '1' END AS iserror, "
    + _note_text()
    + " AS text FROM {documents}",
    "demographics": """
        SELECT c_custkey AS PID, CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS GENDER,
               20 + abs(c_acctbal) / 150 AS AGE, CAST(c_nationkey % 3 = 0 AS INT) AS `Diabetes mellitus`,
               CAST(c_nationkey % 4 = 0 AS INT) AS Hypertension,
               CAST(c_nationkey % 5 = 0 AS INT) AS `Cardiac dysrhythmias`,
               CAST(c_nationkey % 10 = 0 AS INT) AS `Cardiac arrest and ventricular fibrillation`,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'MICU' WHEN 'BUILDING' THEN 'CSRU'
                    WHEN 'AUTOMOBILE' THEN 'SICU' WHEN 'FURNITURE' THEN 'CCU' ELSE 'TSICU' END AS ICU,
               CAST(c_acctbal < 2000 AS INT) AS MORTALITY_INUNIT
        FROM {customer}""",
    "demographics_repeated": """
        SELECT o_custkey AS PID, 'M' AS GENDER, 60.0 AS AGE FROM {orders}""",
    "observations": """
        SELECT user_id AS pid, ts AS charttime, event_type AS feature, value FROM {events}""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in SOURCES}
    return spark.sql(VIEWS[name].format(ntz="TIMESTAMP_NTZ", **tables))


def sql_view(name: str) -> str:
    tables = {t: t for t in SOURCES}
    return VIEWS[name].format(ntz="TIMESTAMP", **tables).replace("`", '"')


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

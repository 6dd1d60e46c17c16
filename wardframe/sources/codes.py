"""Clinical code lists as plain data; joined or inlined instead of long CASE chains.

Fixed values: item ids, ICD-9 codes, unit labels, drug names and limits below have to
be exactly these for the results to be right.
"""

from __future__ import annotations

# Primary ICD-9 codes of the two infarction cohorts.
STEMI_ICD9 = (
    "41000", "41001", "41002", "41010", "41011", "41012", "41020", "41021", "41022",
    "41030", "41031", "41032", "41040", "41041", "41042", "41050", "41051", "41052",
    "41080", "41081", "41082", "41090", "41091", "41092", "4110", "4111",
)
NSTEMI_ICD9 = ("41070", "41071", "41072")

# Procedures of interest (reported with a leading "P").
PROCEDURE_ICD9 = (
    "3615", "3612", "3613", "3961", "9962", "3995", "9920", "3607", "3606", "45",
    "9604", "3722", "9904", "966", "3761", "3723", "3778",
)

# Unit conversion of charted measurements.
FAHRENHEIT_ITEMS = (678, 679, 223761)
FAHRENHEIT_ABOVE = 50.0
INCH_ITEMS = (226707,)
INCH_BELOW = 100.0
UNIT_LABELS = {"inch": "cm", "deg. f": "Deg. C", "?f": "Deg. C"}

# Ventilation.
VENT_SETTING_ITEMS = (
    445, 448, 449, 450, 1340, 1486, 1600, 224687, 639, 654, 681, 682, 683, 684, 224685,
    224684, 224686, 218, 436, 535, 444, 459, 224697, 224695, 224696, 224746, 224747, 221,
    1, 1211, 1655, 2000, 226873, 224738, 224419, 224750, 227187, 543, 5865, 5866, 224707,
    224709, 224705, 224706, 60, 437, 505, 506, 686, 220339, 224700, 3459, 501, 502, 503,
    224702, 223, 667, 668, 669, 670, 671, 672, 224701,
)
VENT_TYPE_ITEM, VENT_TYPE_EXCLUDED = 720, "Other/Remarks"
VENT_MODE_TYPE_ITEM, VENT_MODE_TYPE_EXCLUDED = 223848, "Other"
VENT_MODE_ITEM = 223849
O2_DEVICE_ITEM_CV = 467
O2_DEVICE_ITEM_MV = 226732
O2_DEVICES_MV = (
    "Nasal cannula", "Face tent", "Aerosol-cool", "Trach mask ", "High flow neb",
    "Non-rebreather", "Venti mask ", "Medium conc mask ", "T-piece",
    "High flow nasal cannula", "Ultrasonic neb", "Vapomist",
)
O2_DEVICES_CV = (
    "Cannula", "Nasal Cannula", "Face Tent", "Aerosol-Cool", "Trach Mask", "Hi Flow Neb",
    "Non-Rebreather", "Venti Mask", "Medium Conc Mask", "Vapotherm", "T-Piece", "Hood",
    "Hut", "TranstrachealCat", "Heated Neb", "Ultrasonic Neb",
)
O2_OTHER_ITEMS = (468, 469, 470, 471, 227287, 223834)
EXTUBATION_ITEM = 640
EXTUBATED_VALUES = ("Extubated", "Self Extubation")
SELF_EXTUBATED_VALUE = "Self Extubation"
EXTUBATION_PROCEDURES = (227194, 225468, 225477)
SELF_EXTUBATION_PROCEDURE = 225468
VENT_OUTPUT_ITEMS = {"mech_vent": 226260, "oxygen_therapy": 226732, "extubated": 227194}

# Infused items and the unit each is accepted in.
INPUT_ITEMS = (
    30025, 30042, 30045, 30100, 30110, 30112, 30115, 30134, 30185, 30186, 30209, 30306,
    30310, 30315, 30316, 30321, 30381, 41693, 41694, 42342, 42423, 42512, 42647, 42648,
    42763, 44354, 44518, 44609, 44927, 45186, 45322, 45939, 46047, 46056, 46216, 46484,
    221261, 221347, 221468, 221653, 222318, 223257, 223258, 223259, 223260, 223261,
    223262, 225151, 225152, 225157, 225906, 225908, 225958, 225974, 225975, 228339,
)
INPUT_MG_ITEMS = (
    30134, 30110, 30115, 42648, 30112, 30042, 221261, 225151, 225157, 225906, 225908,
    225974, 222318, 221468, 221347, 228339, 221653,
)
INPUT_UNIT_ITEMS = (30025, 30045, 30100, 225152, 223257, 223258, 223259, 223261, 223262)
INPUT_UNIT_TEXT = {"cv": "u", "mv": "units"}
REWRITTEN_STATUS = "Rewritten"

# Prescribed items and the unit each is accepted in.
RX_MG_ITEMS = (
    7325, 70166, 1620287, 221261, 225151, 225157, 225906, 1363, 225908, 225974, 4147,
    54836, 37707, 1968, 30115, 227440, 3349, 42648, 65374, 286651, 74554, 85542, 1101751,
    22252, 17245, 33228, 223260, 30112, 221653, 221662,
)
RX_UNIT_ITEMS = (30025, 4475, 223258, 223260)
DOSE_FACTOR_HEPARIN = 0.0071
DOSE_FACTOR_INSULIN = 0.0347
HEPARIN_RX_ITEMS = (30025,)
INSULIN_RX_ITEMS = (4475, 223260)

# Names that only the survey of units counts; they have no item.
SURVEY_ONLY_NAMES = (
    "low-molecular-weight", "bisoprolol", "concor", "ziac", "maxsoten", "bezafibrate", "cedur",
)

# Drug names (lower case) per item id.
DRUG_NAMES = {
    1101751: (
        "rosuvastatin", "rosuvastatin calcium", "crestor", "ezallor",
    ),
    7325: (
        "aspirin", "aas", "as", "asa", "aspirin (buffered)", "aspirin (rectal)",
        "acetylsalicylic acid", "salicylic acid", "aspi", "aspir", "aspiri", "aspirin desens",
        "aspirin desensitization", "aspirin desensitization (aerd)",
        "aspirin desensitization (angioedema)", "aspirin ec",
    ),
    70166: (
        "plavix", "clopidogrel", "clopidogrel bisulfate", "clopidogrel desensitization",
    ),
    1620287: (
        "prasugrel", "effient",
    ),
    221261: (
        "abciximab", "reopro",
    ),
    225151: (
        "eptifibatide", "integrilin",
    ),
    225157: (
        "tirofiban", "aggrastat",
    ),
    225906: (
        "enoxaparin", "enoxaparin sodium", "clexane", "lovenox",
    ),
    1363: (
        "bivalirudin", "angiomax", "angiox",
    ),
    225908: (
        "fondaparinux", "fondaparinux sodium",
    ),
    225974: (
        "metoprolol", "metoprolol succinate xl", "metoprolol tartrate", "metoprolol xl",
        "metoprolol xl (toprol xl)", "metoprolo", "betaloc", "spesicor", "lopressor", "toprol",
        "toprol xl",
    ),
    4147: (
        "atenolol", "tenormin",
    ),
    54836: (
        "carvedilol", "coreg", "coreg cr",
    ),
    37707: (
        "sotalol", "sotalol hcl",
    ),
    1968: (
        "verapamil", "verapamil hcl", "verapamil sr", "iproveratril", "calan", "calan sr",
        "overa hs", "isoptin", "verelan", "verelan pm", "verapamil drip",
    ),
    30115: (
        "diltiazem", "diltiazem extended-release", "cardizem", "cardizem cd", "cardizem la",
        "cardizem sr", "cartia xt", "dilacor xr", "dilt-cd", "dilt xr", "diltia xt",
        "taztia xt", "tiamate", "tiazac",
    ),
    227440: (
        "digoxin", "digoxin immune fab", "cardoxin", "digitek", "lanoxicaps", "lanoxin",
        "dilanacin",
    ),
    3349: (
        "captopril", "capoten", "kaplon",
    ),
    42648: (
        "enalapril maleate", "enalapril", "vasotec", "vasotec iv", "enalaprilat",
    ),
    65374: (
        "lisinopril",
    ),
    286651: (
        "atorvastatin", "atorvastatin study drug", "lipitor",
    ),
    74554: (
        "simvastatin", "lovastatin", "simvastatin or placebo", "velastatin", "synvinolin",
    ),
    85542: (
        "pravastatin", "pravachol",
    ),
    22252: (
        "isosorbide dinitrate", "isosorbide dinitrate sa", "isosorbide monon",
        "isosorbide mononitrate", "isosorbide mononitrate (extended release)",
        "isosorbide mononi", "isosorbide mononitra",
    ),
    17245: (
        "gemfibrozil", "lopid",
    ),
    33228: (
        "tricor", "fenofibrate", "fenofibrate micronized", "fibricor", "lofibra",
    ),
    30112: (
        "amiodarone", "amiodarone hcl", "cordarone", "pacerone",
    ),
    221653: (
        "dobutamine", "dobutamine hcl", "dobutrex",
    ),
    221662: (
        "dopamine", "dopamine hcl",
    ),
    30025: (
        "unfractionated heparin", "heparin", "heparin (crrt machine priming)",
        "heparin (iabp)", "heparin crrt", "heparin dwell (1000 units/ml)",
        "heparin flush (10 units/ml)", "heparin flush (100 units/ml)",
        "heparin flush (1000 units/ml)", "heparin flush (5000 units/ml)",
        "heparin flush crrt (5000 units/ml)", "heparin flush cvl  (100 units/ml)",
        "heparin flush hickman (100 units/ml)", "heparin flush midline (100 units/ml)",
        "heparin flush picc (100 units/ml)", "heparin flush port (10 units/ml)",
        "heparin flush port (10units/ml)", "heparin lock flush", "hepatitis b vaccine",
        "heparin dose", "heparin flush 10u/cc", "heparin flush", "heparin sodium",
        "heparin level", "heparin depend antby", "heparin/pic flush", "45ns + 1:1 heparin",
        ".9ns + 0.5:1 heparin", "heparin via sheaths", "1000ns/1000uheparin",
        ".25 ns+0.5:1 heparin", ".25 ns +1:1 heparin", ".45ns + .5:1 heparin",
        ".9ns + 1:1 heparin", "heparin(10 units/cc)", "pn d9.5 w/ heparin",
        "na acetate/heparin", "crrt heparin", "d10w with heparin", "tpnd9.5+heparin",
        "na acetate w/heparin", "heparin dose (per hour)", "heparin sodium (prophylaxis)",
        "heparin concentration (units/ml)", "heparin (hemodialysis)",
    ),
    4475: (
        "insulin", "insulin pump", "humalog insulin", "insulin human nph", "insulin novolog",
        "insulin pump (self administering medication)", "insulin regular human (u-500)",
        "insulin regular pork (iletin ii)", "neo*iv*insulin (dilute)",
    ),
    223258: (
        "insulin human regular", "humulin-r insulin",
    ),
    223260: (
        "insulin glargine", "lantus",
    ),
}

# First-day laboratory items, label and upper limit (above it: no value).
FIRST_DAY_LABS = (
    (50868, "ANION GAP", 10000), (50862, "ALBUMIN", 10), (50882, "BICARBONATE", 10000),
    (50885, "BILIRUBIN", 150), (50912, "CREATININE", 150), (50806, "CHLORIDE", 10000),
    (50902, "CHLORIDE", 10000), (50809, "GLUCOSE", 10000), (50931, "GLUCOSE", 10000),
    (50810, "HEMATOCRIT", 100), (51221, "HEMATOCRIT", 100), (50811, "HEMOGLOBIN", 50),
    (51222, "HEMOGLOBIN", 50), (50813, "LACTATE", 50), (50960, "MAGNESIUM", 60),
    (50970, "PHOSPHATE", 60), (51265, "PLATELET", 10000), (50822, "POTASSIUM", 30),
    (50971, "POTASSIUM", 30), (51275, "PTT", 150), (51237, "INR", 50), (51274, "PT", 150),
    (50824, "SODIUM", 200), (50983, "SODIUM", 200), (51006, "BUN", 300),
    (51300, "WBC", 1000), (51301, "WBC", 1000),
)
LAB_LABELS = (
    "ANION GAP", "ALBUMIN", "BICARBONATE", "BILIRUBIN", "CREATININE", "CHLORIDE",
    "GLUCOSE", "HEMATOCRIT", "HEMOGLOBIN", "LACTATE", "MAGNESIUM", "PHOSPHATE",
    "PLATELET", "POTASSIUM", "PTT", "INR", "PT", "SODIUM", "BUN", "WBC",
)

# Substrings that identify drug items in the item dictionary.
DISCOVERY_TERMS = (
    "aspirin", "clopidogrel", "plavix", "bisulfate", "prasugrel", "effient", "ticagrelor",
    "brilinta", "cangrelor", "abciximab", "reopro", "eptifibatide", "integrilin",
    "tirofiban", "aggrastat", "heparin", "enoxaparin", "clexane", "lovenox",
    "bivalirudin", "fondaparinux", "metoprolol", "betaloc", "spesicor", "lopressor",
    "toprol", "atenolol", "tenormin", "bisoprolol", "concor", "ziac", "carvedilol",
    "coreg", "sotalol", "verapamil", "iproveratril", "calan", "covera", "isoptin",
    "verelan", "diltiazem", "cardizem", "cartia", "dilacor", "dilt", "taztia", "tiamate",
    "tiazac", "digoxin", "cardoxin", "digitek", "lanoxicaps", "dilanacin", "captopril",
    "capoten", "kaplon", "enalapril", "vasotec", "atorvastatin", "lipitor",
    "simvastatin", "lovastatin", "velastatin", "synvinolin", "pravastatin", "pravachol",
    "rosuvastatin", "crestor", "ezallor", "maxsoten", "sosorbide", "gemfibrozil", "lopid",
    "bezafibrate", "cedur", "fenofibrate", "tricor", "fibricor", "lofibra", "amiodarone",
    "cordarone", "pacerone", "dobutamine", "dobutrex", "dopamine", "levosimendan",
    "insulin",
)

# The seven modelled vital signs, in series order, and display labels.
VITALS = (
    "arterial_bp_mean", "respiratory_rate", "diastolic_bp", "spo2", "heart_rate",
    "systolic_bp", "temperature",
)
VITALS_ES = {
    "systolic_bp": "Presión arterial sistólica (mmHg)",
    "respiratory_rate": "Frecuencia respiratoria (bpm)",
    "diastolic_bp": "Presión arterial diastólica (mmHg)",
    "heart_rate": "Frecuencia cardiaca (bpm)",
    "arterial_bp_mean": "Presión arterial media (mmHg)",
    "spo2": "SpO2",
    "temperature": "Temperatura (C)",
}

# Intensive-care unit names that become one-hot flags.
ICU_UNITS = ("MICU", "CSRU", "SICU", "CCU", "TSICU")

# Note categories exported one by one (two carry a trailing blank).
NOTE_CATEGORIES = (
    "Nursing/other", "Physician ", "Radiology", "Nursing", "Discharge summary", "Echo",
    "Respiratory ", "Nutrition", "General", "Rehab Services", "Social Work",
    "Case Management", "Consult", "ECG",
)

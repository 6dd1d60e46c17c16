"""What to look for in free text: categories, patterns, item ids and units.

Fixed values: the patterns, item ids, units and category names decide which values are
found, so they are given as they are, in Java syntax. Every pattern is free of look-around
and back-references and has the same leftmost-first meaning in any Perl-style engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Note categories (two of them end in a blank).
ECHO = "Echo"
GENERAL = "General"
CONSULT = "Consult"
PHYSICIAN = "Physician "
DISCHARGE = "Discharge summary"
NUTRITION = "Nutrition"
FLOWSHEET_CATEGORIES = (
    "Consult", "Nursing", "Nursing/other", "Rehab Services", "General", "Physician ",
)
MEDICATION_CATEGORIES = (
    "General", "Nursing", "Nursing/other", "Physician ", "Consultant", "Consult",
)


@dataclass(frozen=True)
class Finding:
    """One value pattern: group 1 is the value; ``needs`` is a literal of every match."""

    itemid: int
    unit: str
    pattern: str
    needs: str
    categories: tuple[str, ...] = ()


# Echo and flowsheet vital signs, case-sensitive raw text.
ECHO_TIME = r"Date/Time: [\[\]0-9*-]+ at ([0-9:]+)"
ECHO_HEIGHT = Finding(226730, "cm", r"Height: \(in\)(.*?)\n", "Height: (in)")
ECHO_WEIGHT = Finding(226846, "kg", r"Weight \(lb\): ([0-9]+)\n", "Weight (lb): ")
ECHO_SYSTOLIC = Finding(51, "mmHg", r"BP \(mm Hg\): ([0-9]+)", "BP (mm Hg): ")
ECHO_DIASTOLIC = Finding(8368, "mmHg", r"BP \(mm Hg\): [0-9]+/([0-9]+)", "BP (mm Hg): ")
ECHO_HEART_RATE = Finding(211, "bpm", r"HR \(bpm\): (.*?)\n", "HR (bpm): ")

# Infusions in general and consult notes, case-sensitive raw text.
FLOWSHEET_TIME_RAW = r"Flowsheet Data as of  [\[\]0-9*-]+ ([0-9:]+)"


@dataclass(frozen=True)
class Infusion:
    itemid: int
    label: str
    rate_unit: str
    unit: str
    category: str
    strict_unit: bool


INFUSIONS = (
    Infusion(30045, "Insulin - Regular", "units/hour", "unit", GENERAL, True),
    Infusion(217, "Heparin Sodium", "units/hour", "unit", GENERAL, False),
    Infusion(30112, "Amiodarone", "mg/min", "unit", GENERAL, True),
    Infusion(30112, "Amiodarone", "mg/min", "mg", CONSULT, True),
)

# Biomarkers in flowsheet notes (lower-cased, blanks squeezed). The first and the last
# pattern are own ones: they read the whole decimal number, ask for its decimal part, and the MB index
# does not start inside "ck-mb".
FLOWSHEET_DATE = r"flowsheet data as of ([\[\]0-9*-]+)"
FLOWSHEET_TIME = r"flowsheet data as of [\[\]0-9*-]+ ([0-9:]+)"
FLOWSHEET_BIOMARKERS = (
    Finding(
        227429, "ng/ml",
        r"trop[a-z:]*[ -]?[a-z:]* ?[<>]? ?([0-9]+\.[0-9]+)(?:[^0-9./]|\.[^0-9]|\.?$)", "trop",
    ),
    Finding(227429, "ng/ml", r"troponin[ -]?t?:? ?[0-9:]+/[0-9:]+/([0-9]\.[0-9]+)", "troponin",
            (GENERAL, PHYSICIAN)),
    Finding(50911, "ng/ml", r"[,]? ?ck[-]?mb[-]?[>]? ?[a-z]*? ([0-9:]+)", "mb"),
    Finding(50910, "ng/ml", r"ck[-]?[>]? ?[a-z]*? ([0-9:]+)", "ck"),
    Finding(51091, "ng/ml", r"(?:^|[^a-z-])mb [a-z]*? ?([0-9]+\.[0-9]+)", "mb "),
)

# Biomarkers in discharge summaries. ``fragment`` finds date, clock and
# value together; ``value`` then reads the value inside the fragment.
@dataclass(frozen=True)
class DischargeFragment:
    itemid: int
    unit: str
    fragment: str
    value: str
    needs: str
    fallback_hours: int = 0
    use_clock: bool = True


DISCHARGE_FRAGMENTS = (
    DischargeFragment(
        50911, "ng/ml",
        r"([\[\]0-9*-]+ ?[0-9:]+[p]?[m]?[a]?[m]? ?[a-z]+? ?ck[-]?mb[-]? ?[>]?[0-9:]+)",
        r"ck[-]?mb[-]? ?[>]?([0-9:]+)", "mb",
    ),
    DischargeFragment(
        50911, "ng/ml",
        r"([\[\]0-9*-]+ ?[0-9:]+[p]?[m]?[a]?[m]? ck[(]?[c]?[p]?[k]?[)]?[-]?[\[0-9:]+\]?[*]? ?ck-mb[-]? ?[>]?[0-9:]+)",
        r"ck-mb[-]? ?[>]?([0-9:]+)", "ck-mb",
    ),
    DischargeFragment(
        50910, "iu/l",
        r"([\[\]0-9*-]+ ?[0-9:]+[p]?[m]?[a]?[m]? ?ck[-]?[>]? ?[>]?[0-9:]+)",
        r"ck[-]?[>]? ?[>]?([0-9:]+)", "ck",
    ),
    DischargeFragment(
        227429, "ng/ml",
        r"([\[\]0-9*-]+ ?[0-9:]+[p]?[m]?[a]?[m]? ?[a-z]+? ?[a-z]+?[-]?[a-z]+?[-]? ?[>]?[0-9:]+? ?[c]?trop[a-z]?[a-z]?[-]? ?[0-9:]+.[0-9:]+)",
        r"ctropnt[-]? ?[>]?([0-9:]+.[0-9:]+)", "trop",
    ),
    DischargeFragment(
        227429, "ng/ml",
        r"([\[\]0-9*-]+ ?[0-9:]+[p]?[m]?[a]?[m]? ?[c]?trop[a-z]?[a-z]?[-]? ?[>]?[0-9:]+.[0-9:]+)",
        r"ctropnt[-]? ?[>]?([0-9:]+.[0-9:]+)", "trop",
    ),
    DischargeFragment(
        227429, "ng/ml",
        r"([\[\]0-9*-]+ ?[0-9:]+[p]?[m]?[a]?[m]? ?[a-z]+? ?[a-z]+?[-]?[a-z]+?[-]? ?[a-z]+? ?[c]?trop[a-z]?[a-z]?[-]? ?[>]?[0-9:]+.[0-9:]+)",
        r"ctropnt[-]? ?[>]?([0-9:]+.[0-9:]+)", "trop",
    ),
    DischargeFragment(
        227429, "ng/ml",
        r"([\[\]0-9*-]+ ?[0-9:]+[p]?[m]?[a]?[m]? ?[a-z]+? ?[c]?[k]?[-]?[a-z]+?[-]? ?[0-9:]+?[*]? ?[a-z]+? ?[a-z]+?[-]?[0-9:]+?[.]?[0-9:]+?[*]? ?[c]?trop[a-z]?[a-z]?[-]? ?[>]?[0-9:]+.[0-9:]+)",
        r"ctropnt[-]? ?[>]?([0-9:]+.[0-9:]+)", "trop",
    ),
    DischargeFragment(
        51091, "ng/ml",
        r"([\[\]0-9*-]+ ?[0-9:]+[p]?[m]?[a]?[m]? ?[a-z]+? ?[a-z]+?[-]?[a-z]+?[-]?[0-9:]+?[*]? ?mb indx[-]?[0-9:]+.[0-9:]+)",
        r"mb ?indx[-]? ?[>]?([0-9:]+.[0-9:]+)", "mb indx",
    ),
    DischargeFragment(
        51091, "ng/ml",
        r"([\[\]0-9*-]+ ?[0-9:+]? ?[0-9:+]?[p]?[m]?[a]?[m]? ?ck[\(]?[a-z]+?[\)]?[-]?[0-9:]+?[*]? ?[a-z]+?[-]?[a-z]+?[-]?[0-9:]+?[*]? mb ?[a-z]+?[-]?[0-9:]+?[.]?[0-9:]+)",
        r"mb ?indx[-]? ?[>]?([0-9:]+.[0-9:]+)", " mb", 2, False,
    ),
)
PERTINENT_DATE = r"pertinent results: ?([\[\]0-9*-]+)"
PERTINENT_DATE_LATER = r"pertinent results: ?[a-z:]+? ?[a-z:]+?[:]? ?([\[\]0-9*-]+)"
DISCHARGE_LOCKSTEP = (
    Finding(50911, "ng/ml", r"[,]? ?ck[-]?mb[-]?[>]? ?[a-z]*? ([0-9:]+)", "mb"),
    Finding(50910, "iu/l", r"ck[-]?[>]? ?[a-z]*? ([0-9:]+)", "ck"),
)
DISCHARGE_MB = Finding(51091, "ng/ml", r"mb [a-z]*? ?([0-9:]+[.]?[0-9:]+)", "mb ")

# Medications. Doses and clocks in priority order; a dose above 1000 is
# divided by 1000 where ``rescale`` is set.
@dataclass(frozen=True)
class Medication:
    itemid: int
    names: tuple[str, ...]
    doses: tuple[str, ...]
    clocks: tuple[str, ...]
    rescale: bool = False
    literals: dict[str, str] = field(default_factory=dict)

    def needs(self, pattern: str) -> str:
        """Longest drug name inside the pattern: present in every text it can match."""
        found = [n for n in self.names if n in pattern]
        return self.literals.get(pattern) or max(found, key=len)


MEDICATIONS = (
    Medication(65374, ("lisinopril",), (
        r"lisinopril ([0-9:\.]+)", r"lisinopril dose to ([0-9:\.]+)",
        r"lisinopril ([0-9:]+)", r"lisinopril ([0-9:]+\.[0-9:]+)",
    ), (
        r"lisinopril at ([0-9:]+)\.", r"lisinopril [0-9:] mg at ([0-9:]+)",
        r"started on lisinopril [0-9:]mg - given at ([0-9:]+)",
    ), True),
    Medication(42648, ("enalapril", "vasotec"), (
        r"enalapril iv (0\.[0-9:]+)", r"enalapril to ([0-9:\.]+)", r"enalapril ([0-9:]+)",
        r"enalapril ([0-9:]+\.[0-9:]+)", r"(?s)given .* ([0-9:]+).* iv vasotec",
        r"on vasotec ([0-9:]+)",
    ), (
        r"enalapril at ([0-9:]+)\.", r"enalapril [0-9:] mg at ([0-9:]+)",
        r"started on enalapril [0-9:]mg - given at ([0-9:]+)",
    ), True, {r"(?s)given .* ([0-9:]+).* iv vasotec": " iv vasotec"}),
    Medication(3349, ("captopril", "capoten"), (
        r"captopril ([0-9:]\.[0-9:]+)", r"captopril ([0-9:]+)", r"captopril to ([0-9:]\.[0-9:]+)",
        r"captopril to ([0-9:]+)", r"captopril ([0-9:]+\.[0-9:]+)", r"capoten ([0-9:]\.[0-9:]+)",
        r"capoten ([0-9:]+)\.",
    ), (
        r"started on captopril [0-9:]mg - given at ([0-9:]+)\.",
        r"captopril [0-9:] mg at ([0-9:]+)\.", r"started on capoten [0-9:] - given at ([0-9:]+)\.",
        r"capoten [0-9:+].* po tid started at ([0-9:]+)\,",
    ), True),
    Medication(286651, ("atorvastatin", "lipitor"), (
        r"atorvastatin ([0-9:]+)", r"atorvastatin to ([0-9:]+)", r"([0-9:]+) mg atorvastatin ",
        r"atorvastatin ([0-9:]+\.[0-9:]+)", r"lipitor ([0-9:\.]+)", r"lipitor to ([0-9:\.]+)",
        r"lipitor ([0-9:]+)", r"lipitor ([0-9:]+\.[0-9:]+)",
    ), (
        r"started on atorvastatin [0-9:]mg - given at ([0-9:]+)",
        r"atorvastatin [0-9:] mg at ([0-9:]+)", r"(?s)atorvastatin .* at ([0-9:]+)\.",
        r"started on lipitor [0-9:]mg - given at ([0-9:]+)", r"lipitor [0-9:] mg at ([0-9:]+)",
    )),
    Medication(74554, ("simvastatin", "lovastatin"), (
        r"simvastatin ([0-9:]+)", r"simvastatin to ([0-9:]+)", r"simvastatin ([0-9:]+\.[0-9:]+)",
        r"lovastatin ([0-9:]+)", r"lovastatin ([0-9:]+\.[0-9:]+)",
    ), (
        r"simvastatin at ([0-9:]+)\.", r"simvastatin [0-9:] mg at ([0-9:]+)",
        r"started on simvastatin [0-9:]mg - given at ([0-9:]+)",
    )),
    Medication(85542, ("pravastatin", "pravachol"), (
        r"pravastatin ([0-9:]+)", r"pravastatin to ([0-9:]+)", r"pravastatin (0\.[0-9:]+)",
        r"([0-9:]+) mg pravastatin", r"pravastatin ([0-9:]+\.[0-9:]+)", r"pravachol ([0-9:]+)",
        r"pravachol ([0-9:]+\.[0-9:]+)",
    ), (
        r"started on pravastatin [0-9:]mg - given at ([0-9:]+)",
        r"pravastatin [0-9:] mg at ([0-9:]+)", r"pravastatin at ([0-9:]+)\.",
        r"started on pravachol [0-9:] - given at ([0-9:]+)", r"pravachol [0-9:] mg at ([0-9:]+)",
    )),
    Medication(1101751, ("rosuvastatin", "crestor"), (
        r"rosuvastatin ([0-9:]+)", r"rosuvastatin to ([0-9:]+)", r"rosuvastatin (0\.[0-9:]+)",
        r"([0-9:]+) mg rosuvastatin", r"rosuvastatin calcium ([0-9:]+)",
        r"rosuvastatin ([0-9:]+\.[0-9:]+)", r"crestor ([0-9:]+)",
    ), (
        r"started on rosuvastatin [0-9:]mg - given at ([0-9:]+)",
        r"rosuvastatin [0-9:] mg at ([0-9:]+)", r"rosuvastatin at ([0-9:]+)\.",
        r"started on crestor [0-9:] - given at ([0-9:]+)", r"crestor [0-9:] mg at ([0-9:]+)",
    )),
    Medication(42647, ("metoprolol", "lopressor", "toprol"), (
        r"metoprolol to ([0-9:]+)", r"metoprolol (0\.[0-9:]+)", r"metoprolol ([0-9:]+)",
        r"([0-9:]+) mg metoprolol", r"([0-9:]+\.[0-9:]+)mg metoprolol",
        r"metoprolol ([0-9:]+\.[0-9:]+)", r"metoprolol tartrate ([0-9:]+\.[0-9:]+)",
        r"metoprolol tartrate ([0-9:]+)", r"lopressor ([0-9:]+)", r"lopressor ([0-9:]+\.[0-9:]+)",
        r"toprol ([0-9:]+)", r"toprol xl ([0-9:]+)", r"([0-9:]+)mg toprol",
        r"metoprolol succinate ([0-9:]+)", r"metoprolol succinate ([0-9:]+\.[0-9:]+)",
        r"metoprolol succinate \(([0-9:]+\.[0-9:]+)", r"metoprolol xl ([0-9:]+\.[0-9:]+)",
        r"metoprolol xl ([0-9:]+)",
    ), (
        r"started on metoprolol [0-9:]mg - given at ([0-9:]+)", r"metoprolol [0-9:]mg at ([0-9:]+)",
        r"metoprolol at ([0-9:]+)\.", r"lopressor [0-9:] mg at ([0-9:]+)",
        r"toprol [0-9:] mg xl @ ([0-9:]+)",
    ), True),
    Medication(4147, ("atenolol",), (
        r"atenolol ([0-9:]+\.[0-9:]+)", r"atenolol (0\.[0-9:]+)", r"atenolol ([0-9:]+)",
        r"([0-9:]+) mg po atenolol", r"([0-9:]+\.[0-9:]+)mg atenolol",
    ), (
        r"started on atenolol [0-9:]mg - given at ([0-9:]+)", r"atenolol [0-9:] mg at ([0-9:]+)",
        r"atenolol [0-9:]+ at ([0-9:]+)\.",
    ), True),
    Medication(54836, ("carvedilol", "coreg"), (
        r"carvedilol ([0-9:]+\.[0-9:]+)", r"carvedilol (0\.[0-9:]+)", r"carvedilol ([0-9:]+)",
        r"([0-9:]+) mg po carvedilol", r"([0-9:]+\.[0-9:]+)mg carvedilol",
        r"coreg ([0-9:]+\.[0-9:]+)", r"coreg (0\.[0-9:]+)", r"coreg ([0-9:]+)",
    ), (
        r"started on carvedilol [0-9:]mg - given at ([0-9:]+)", r"carvedilol [0-9:] at ([0-9:]+)",
        r"carvedilol at ([0-9:]+)\.",
    ), True),
    Medication(37707, ("sotalol",), (
        r"sotalol ([0-9:]+\.[0-9:]+)", r"sotalol (0\.[0-9:]+)", r"sotalol ([0-9:]+)",
    ), (
        r"started on sotalol [0-9:]mg - given at ([0-9:]+)", r"sotalol [0-9:] mg at ([0-9:]+)",
        r"sotalol [0-9:]+ at ([0-9:]+)\.",
    ), True),
    Medication(7325, ("aspirin", "aas", "asa", "acetylsalicylic acid"), (
        r"aspirin ([0-9:]+\.[0-9:]+)", r"aspirin (0\.[0-9:]+)", r"aspirin ([0-9:]+)",
        r"aas ([0-9:]+)", r"asa ([0-9:]+)", r"asa ([0-9:]+\.[0-9:]+)",
        r"aspirin \(buffered\) ([0-9:]+)", r"aspirin \(rectal\) ([0-9:]+)",
        r"acetylsalicylic acid ([0-9:]+)", r"aspirin ec ([0-9:]+)",
    ), (
        r"started on aspirin [0-9:]mg - given at ([0-9:]+)", r"aspirin [0-9:] mg at ([0-9:]+)",
        r"aspirin [0-9:]+ at ([0-9:]+)\.",
    ), True),
)

# Laboratory values in nutrition notes. ``number`` is the value syntax;
# ``unit`` is given where the note's own unit is not used.
@dataclass(frozen=True)
class NutritionLab:
    itemid: int
    name: str
    number: str
    between: str
    unit: str | None = None

    @property
    def literal(self) -> str:
        return self.name.replace("\\", "")

    @property
    def pattern(self) -> str:
        return (
            f"({self.name} ?{self.number} ?{self.between}"
            r" ?[\[\]0-9*-]+ ?[0-9:]+ ?[p]?[m]?[a]?[m]?)"
        )


_WHOLE, _POINT = "[0-9:]+", "[0-9:]+.[0-9:]+"
_UNIT = "[a-z:]+?[/]?[a-z:]+?"
NUTRITION_LABS = (
    NutritionLab(50809, "glucose", _WHOLE, _UNIT),
    NutritionLab(225664, "glucose finger stick", _WHOLE, "", "mg/dl"),
    NutritionLab(51006, "bun", _WHOLE, _UNIT),
    NutritionLab(50912, "creatinine", _POINT, _UNIT),
    NutritionLab(50983, "sodium", _WHOLE, _UNIT),
    NutritionLab(50971, "potassium", _POINT, _UNIT),
    NutritionLab(50902, "chloride", _WHOLE, _UNIT),
    NutritionLab(50804, "tco2", _WHOLE, _UNIT),
    NutritionLab(50821, r"po2 \(arterial\)", _WHOLE, "[a-z:]+? [a-z:]+?", "mmHg"),
    NutritionLab(50818, r"pco2 \(arterial\)", _WHOLE, "[a-z:]+? ?[a-z:]+?", "mmHg"),
    NutritionLab(50820, r"ph \(arterial\)", _POINT, _UNIT),
    NutritionLab(225698, r"co2 \(calc\) arterial", _WHOLE, _UNIT),
    NutritionLab(50862, "albumin", _POINT, _UNIT),
    NutritionLab(225625, "calcium non-ionized", _POINT, _UNIT),
    NutritionLab(225677, "phosphorus", _POINT, _UNIT),
    NutritionLab(220635, "magnesium", "[0-9:].[0-9:]+", _UNIT),
    NutritionLab(225612, "alkaline phosphate", _WHOLE, _UNIT),
    NutritionLab(50878, "ast", _WHOLE, _UNIT),
    NutritionLab(50867, "amylase", _WHOLE, _UNIT),
    NutritionLab(50885, "total bilirubin", _POINT, _UNIT),
    NutritionLab(51301, "wbc", _POINT, _UNIT),
    NutritionLab(50811, "hgb", _POINT, _UNIT),
    NutritionLab(51221, "hematocrit", _POINT, "[%]?"),
)

# Troponin as the largest of several readings, per category.
TROPONIN_ITEM, TROPONIN_UNIT = 227429, "ng/ml"
_TROPONIN_COMMON = (
    r"troponin ([0-9:]+.[0-9:]+)", r"trop ([0-9:]+.[0-9:]+)", r"troponin<([0-9:].[0-9:]+)",
    r"trop t: ([0-9:]+.[0-9:]+)", r"troponin of ([0-9:].[0-9:]+)", r"troponin ([0-9:].[0-9:]+)",
    r"troponin: ([0-9:]+.[0-9:]+)", r"trop >([0-9:]+)", r"troponin \^([0-9].[0-9:]+)",
)
TROPONIN_GREATEST = {
    "Nursing": (*_TROPONIN_COMMON, r"troponin (.[0-9:]+)"),
    "Nursing/other": (*_TROPONIN_COMMON, r"troponin (.[0-9:]+)", r"trop>([0-9:]+)"),
    "General": (
        *_TROPONIN_COMMON, r"troponin-t:[0-9:]+/[0-9:]+/([0-9:].[0-9:]+)", r"trop-t: ([0-9:]+.[0-9:]+)",
        r"troponin t:[0-9:]+/[0-9:]+/([0-9:]+.[0-9:]+)", r"trop>([0-9:]+)",
    ),
    "Rehab Services": (*_TROPONIN_COMMON, r"troponin (.[0-9:]+)", r"trop>([0-9:]+)"),
    "Consult": (r"troponin-t:[0-9:]+/[0-9:]+/([0-9:].[0-9:]+)", r"tropt ([0-9:]+.[0-9:]+)"),
}
TROPONIN_PHYSICIAN_CASED = (
    r"[Tt]roponin-[Tt]:[0-9:]+/[0-9:]+/([0-9:].[0-9:]+)", r"TropT ([0-9:]+.[0-9:]+)",
    r"Troponin T <([0-9:].[0-9:]+)", r"Troponin-T:[0-9:]+//<([0-9:].[0-9:]+)",
    r"Repeat troponin here was ([0-9:].[0-9:]+)", r"Troponin T ([0-9:].[0-9:]+)",
    r"Troponin T:[0-9:]+/[0-9:]+/([0-9:].[0-9:]+)",
)
FLOWSHEET_TIME_CASED = r"Flowsheet Data as of [\[\]0-9*-]+ ([0-9:]+)"
TROPONIN_PHYSICIAN_PLAIN = r"[c]?trop[n]?[t]?[-]? ?[>]?[<]? ?([0-9:]+.[0-9:]+)"
TROPONIN_PHYSICIAN_TRIPLE = (
    r"trop[o]?[n]?[i]?[n]?[-]? ?[t]? ?[:]?[0-9:]+[.]?[0-9:]*/[0-9:]+[.]?[0-9:]*/([0-9:]+.[0-9:]+)"
)
TROPONIN_DISCHARGE_DATED = (
    r"[c]?trop[n]?[t]?[-]?[>]?[<]? ?([0-9:]+.[0-9:]+[\*]?[0-9]? [\[\]0-9*-]+ [0-9:]+)"
)
TROPONIN_DISCHARGE_BARE = r"[c]?trop[n]?[t]?[onin was ]?[-]?([0-9:]+.[0-9:]+)"
TROPONIN_DISCHARGE_PROSE = (
    r"trop[o]?[n]?[i]?[n]?[t]? ?[w]?[a]?[s]?[o]?[f]?[t]?[o]? [~]?([0-9:]+.[0-9:]+)"
)

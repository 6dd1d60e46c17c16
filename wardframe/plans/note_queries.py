"""Structured events from free text, checked against plain SQL over the same notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardframe.functions import text as tx
from wardframe.functions import times as tm
from wardframe.operators import notes as no
from wardframe.plans.inputs import source, spark_view, sql_view
from wardframe.plans.registry import listed, query, with_views
from wardframe.plans.structured import IN_COHORT, STEMI, stemi
from wardframe.sources import note_catalogue as cat
from wardframe.sources import readers, writers

# --- SQL building blocks -----------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _first(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, 1), '')"


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {_q(pattern)}, 1)"


def _num(text: str) -> str:
    return f"try_cast(nullif(trim({text}), '') AS DOUBLE)"


def _squeezed(text: str) -> str:
    return f"replace(replace(replace(replace({text}, chr(10), ' '), ' ', '*^'), '^*', ''), '*^', ' ')"


def _stamp(day: str, clock: str | None) -> str:
    """Timestamp of a date like [**2100-1-1**] and a clock like 1:23am."""
    date = (
        f"nullif(regexp_extract({day}, '([0-9]{{4}})-[0-9]{{1,2}}-[0-9]{{1,2}}', 1), '')"
        f" || '-' || lpad(regexp_extract({day}, '[0-9]{{4}}-([0-9]{{1,2}})-[0-9]{{1,2}}', 1), 2, '0')"
        f" || '-' || lpad(regexp_extract({day}, '[0-9]{{4}}-[0-9]{{1,2}}-([0-9]{{1,2}})', 1), 2, '0')"
    )
    if clock is None:
        return f"try_cast({date} AS TIMESTAMP)"
    form = "^([0-9]{1,2}):?([0-9]{2})(?::[0-9]{2})? ?([ap]?)"
    h = f"try_cast(regexp_extract({clock}, '{form}', 1) AS INT)"
    half = f"regexp_extract({clock}, '{form}', 3)"
    hour = f"CASE WHEN {half} = 'p' AND {h} < 12 THEN {h} + 12 WHEN {half} = 'a' AND {h} = 12 THEN 0 ELSE {h} END"
    time = f"lpad(CAST({hour} AS VARCHAR), 2, '0') || ':' || regexp_extract({clock}, '{form}', 2) || ':00'"
    return f"coalesce(try_cast({date} || ' ' || {time} AS TIMESTAMP), try_cast({date} AS TIMESTAMP))"


def _on_day(clock: str) -> str:
    digits = f"lpad(replace({clock}, ':', ''), 4, '0')"
    return (
        f"coalesce(try_cast(strftime(chartdate, '%Y-%m-%d') || ' ' || {digits}[1:2] || ':' || {digits}[3:4] || ':00'"
        " AS TIMESTAMP), chartdate)"
    )


def _events(rows: str, time: str, item: str, value: str, unit: str) -> str:
    return f"""SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, chartdate AS CHARTDATE, {time} AS CHARTTIME,
        CAST({item} AS INT) AS ITEMID, {value} AS VALUE, {unit} AS VALUEUOM FROM ({rows}) WHERE {value} > 0"""


_KEYS = "subject_id, hadm_id, chartdate"


def _note(*categories: str) -> str:
    return (
        f"(SELECT {_KEYS}, category, text, lower({_squeezed('text')}) AS note FROM noteevents"
        f" WHERE category IN ({listed(categories)}))"
    )


def _union(parts: list[str], kind: str = "UNION ALL") -> str:
    return f"\n{kind} ".join(parts)


def _notes(spark, sf):
    return readers.spread(spark_view(spark, sf, "noteevents"), "hadm_id")


# --- text functions ----------------------------------------------------------------------


@query("note_collapse", with_views("noteevents") + f"""
    SELECT subject_id, length(note) AS note_length, md5(note) AS note_md5, md5(text) AS text_md5
    FROM (SELECT subject_id, text, lower({_squeezed('text')}) AS note FROM noteevents)""")
def note_collapse(spark, sf):
    rows = _notes(spark, sf).select("subject_id", "text", tx.normalise_note(F.col("text")).alias("note"))
    return rows.select(
        "subject_id", F.length("note").alias("note_length"), F.md5("note").alias("note_md5"), F.md5("text").alias("text_md5")
    )


@query("note_regex_first", with_views("noteevents") + f"""
    SELECT subject_id, {_first('text', cat.ECHO_SYSTOLIC.pattern)} AS systolic,
           {_first('text', 'Heparin Sodium - (.*?)' + chr(10))} AS heparin,
           split_part({_first('text', 'Heparin Sodium - (.*?)' + chr(10))}, ' ', 3) AS beyond
    FROM noteevents""")
def note_regex_first(spark, sf):
    text = F.col("text")
    heparin = tx.first_match(text, "Heparin Sodium - (.*?)\n")
    return _notes(spark, sf).select(
        "subject_id", tx.first_match(text, cat.ECHO_SYSTOLIC.pattern).alias("systolic"),
        heparin.alias("heparin"), tx.split_token(heparin, " ", 3).alias("beyond"),
    )


@query("note_regex_all_lockstep", with_views("noteevents") + f"""
    SELECT subject_id, unnest(a) AS ck, unnest(d) AS day, unnest(c) AS clock
    FROM (SELECT subject_id, {_all('note', 'ck[-]?[>]? ?[a-z]*? ([0-9:]+)')} AS a,
                 {_all('note', cat.FLOWSHEET_DATE)} AS d, {_all('note', cat.FLOWSHEET_TIME)} AS c
          FROM {_note(*cat.FLOWSHEET_CATEGORIES)})""")
def note_regex_all_lockstep(spark, sf):
    note = F.col("note")
    rows = _notes(spark, sf).filter(F.col("category").isin(*cat.FLOWSHEET_CATEGORIES)).select(
        "subject_id", tx.normalise_note(F.col("text")).alias("note")
    )
    return rows.select("subject_id", F.inline(F.arrays_zip(
        tx.all_matches(note, r"ck[-]?[>]? ?[a-z]*? ([0-9:]+)").alias("ck"),
        tx.all_matches(note, cat.FLOWSHEET_DATE).alias("day"),
        tx.all_matches(note, cat.FLOWSHEET_TIME).alias("clock"),
    )))


@query("note_datetime_repair", f"""
    SELECT o_orderkey, {_stamp('day', 'clock')} AS stamp, {_stamp('day', None)} AS day_only,
           CASE WHEN length(split_part(short, '-', 1)) < 4
                THEN year(o_orderdate) || '-' || lpad(split_part(short, '-', 1), 2, '0') || '-' || lpad(split_part(short, '-', 2), 2, '0')
           END AS with_year
    FROM (SELECT o_orderkey, o_orderdate, '[**' || strftime(o_orderdate, '%Y-%-m-%-d') || '**]' AS day,
                 CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 12 + 1 || ':' || (o_orderkey % 50 + 10) || 'am'
                      WHEN 1 THEN o_orderkey % 12 + 1 || ':' || (o_orderkey % 50 + 10) || 'p'
                      WHEN 2 THEN o_orderkey % 30 || ':' || (o_orderkey % 70 + 10) ELSE '' END AS clock,
                 strftime(o_orderdate, '%-m-%-d') AS short FROM orders)""")
def note_datetime_repair(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    hour, minute = (k % 12 + 1).cast("string"), (k % 50 + 10).cast("string")
    clock = (
        F.when(k % 4 == 0, F.concat(hour, F.lit(":"), minute, F.lit("am")))
        .when(k % 4 == 1, F.concat(hour, F.lit(":"), minute, F.lit("p")))
        .when(k % 4 == 2, F.concat((k % 30).cast("string"), F.lit(":"), (k % 70 + 10).cast("string")))
        .otherwise("")
    )
    rows = source(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.concat(F.lit("[**"), F.date_format(day, "yyyy-M-d"), F.lit("**]")).alias("day"),
        clock.alias("clock"), F.date_format(day, "M-d").alias("short"),
    )
    return rows.select(
        "o_orderkey", tm.clinical_timestamp(F.col("day"), F.col("clock")).alias("stamp"),
        tm.clinical_timestamp(F.col("day")).alias("day_only"), tm.yearless_date(F.col("short"), day).alias("with_year"),
    )


@query("note_greatest_text", """
    SELECT l_orderkey, l_linenumber, l_partkey, greatest(a, b) AS text_max, greatest(try_cast(a AS DOUBLE), try_cast(b AS DOUBLE)) AS number_max,
           concat_ws('', a, CASE WHEN l_linenumber > 3 THEN NULL ELSE b END) AS joined
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem)""")
def note_greatest_text(spark, sf):
    a, b = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string")
    return source(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tx.text_max(a, b).alias("text_max"),
        F.greatest(tx.to_number(a), tx.to_number(b)).alias("number_max"),
        tx.join_text(a, F.when(F.col("l_linenumber") <= 3, b)).alias("joined"),
    )


# --- cohort notes and export -------------------------------------------------------------


@query("cohort_notes", with_views("diagnoses_icd", "noteevents", cohort=STEMI) + f"""
    SELECT subject_id AS SUBJECT_ID, hadm_id AS HADM_ID, chartdate AS CHARTDATE, category AS CATEGORY,
           description AS DESCRIPTION, text AS TEXT
    FROM noteevents WHERE iserror IS NULL AND {IN_COHORT}""")
def cohort_notes(spark, sf):
    return no.cohort_notes(_notes(spark, sf), stemi(spark, sf))


@query("notes_flat_by_category", with_views("diagnoses_icd", "noteevents", cohort=STEMI) + f"""
    SELECT subject_id, hadm_id, chartdate, category, replace(text, chr(10), ' ') AS texto
    FROM noteevents WHERE {IN_COHORT}""")
def notes_flat_by_category(spark, sf):
    return writers.flat_notes(_notes(spark, sf), stemi(spark, sf))


# --- echo, infusions, medications ---------------------------------------------------------

_ECHO = _events(
    f"""SELECT {_KEYS}, {_first('text', cat.ECHO_TIME)} AS clock, unnest([
        {{'i': 226730, 'u': 'cm', 'v': CASE WHEN h > 100 AND h < 240 THEN h END}},
        {{'i': 226846, 'u': 'kg', 'v': CASE WHEN w > 50 AND w < 250 THEN w END}},
        {{'i': 51, 'u': 'mmHg', 'v': s}}, {{'i': 8368, 'u': 'mmHg', 'v': d}}, {{'i': 211, 'u': 'bpm', 'v': r}}]) AS x
    FROM (SELECT {_KEYS}, text, {_num(_first('text', cat.ECHO_HEIGHT.pattern))} * 2.54::DOUBLE AS h,
                 {_num(_first('text', cat.ECHO_WEIGHT.pattern))} * 0.45::DOUBLE AS w,
                 {_num(_first('text', cat.ECHO_SYSTOLIC.pattern))} AS s,
                 {_num(_first('text', cat.ECHO_DIASTOLIC.pattern))} AS d,
                 {_num(_first('text', cat.ECHO_HEART_RATE.pattern))} AS r
          FROM noteevents WHERE category = 'Echo' AND hadm_id IS NOT NULL)""",
    _on_day("clock"), "x.i", "x.v", "x.u",
)


@query("note_echo_vitals", with_views("noteevents") + _ECHO)
def note_echo_vitals(spark, sf):
    return no.echo_vitals(_notes(spark, sf))


def _infusion_sql(i: cat.Infusion) -> str:
    line = _first("text", i.label + " - (.*?)\n")
    fits = f"lower(split_part({line}, ' ', 2)) = '{i.rate_unit}'"
    strict = f"AND {fits}" if i.strict_unit else ""
    return f"""SELECT {_KEYS}, {_first('text', cat.FLOWSHEET_TIME_RAW)} AS clock, {i.itemid} AS i,
        {_num(f"replace(split_part({line}, ' ', 1), ',', '')")} AS v, CASE WHEN {fits} THEN '{i.unit}' END AS u
        FROM noteevents WHERE category = '{i.category}' {strict}"""


_INFUSIONS = _events(_union([_infusion_sql(i) for i in cat.INFUSIONS]), _on_day("clock"), "i", "v", "u")


@query("note_infusions", with_views("noteevents") + _INFUSIONS)
def note_infusions(spark, sf):
    return no.infusion_rates(_notes(spark, sf))


def _medication_sql(d: cat.Medication) -> str:
    dose = "coalesce(" + ", ".join(_first("low", p) for p in d.doses) + ")"
    clocks = ", ".join(
        f"CASE WHEN length(replace({_first('low', p)}, ':', '')) = 4 THEN replace({_first('low', p)}, ':', '') END"
        for p in d.clocks
    )
    value = "CASE WHEN v > 1000 THEN v / 1000 ELSE v END" if d.rescale else "v"
    return f"""SELECT {_KEYS}, {d.itemid} AS i, {value} AS v, clock FROM (
        SELECT {_KEYS}, {_num(f"replace({dose}, ':', '')")} AS v, coalesce({clocks}) AS clock
        FROM (SELECT {_KEYS}, lower(text) AS low FROM noteevents WHERE category IN ({listed(cat.MEDICATION_CATEGORIES)})))"""


_MEDICATIONS = _events(_union([_medication_sql(d) for d in cat.MEDICATIONS]), _on_day("clock"), "i", "v", "'mg'")


@query("note_medications", with_views("noteevents") + _MEDICATIONS)
def note_medications(spark, sf):
    return no.medication_doses(_notes(spark, sf))


# --- biomarkers ---------------------------------------------------------------------------


def _flowsheet_sql(f: cat.Finding) -> str:
    categories = f.categories or cat.FLOWSHEET_CATEGORIES
    return f"""SELECT {_KEYS}, {f.itemid} AS i, '{f.unit}' AS u, unnest(a) AS v, unnest(d) AS day, unnest(c) AS clock
        FROM (SELECT {_KEYS}, {_all('note', f.pattern)} AS a, {_all('note', cat.FLOWSHEET_DATE)} AS d,
                     {_all('note', cat.FLOWSHEET_TIME)} AS c FROM {_note(*categories)})"""


_CLEAN_DAY = "translate(day, '[]*', '')"
_FLOWSHEET = _events(
    _union([_flowsheet_sql(f) for f in cat.FLOWSHEET_BIOMARKERS]),
    f"coalesce(CASE WHEN length({_CLEAN_DAY}) > 7 THEN {_stamp(_CLEAN_DAY, 'clock')} END, chartdate)",
    "i", _num("translate(v, ':/', '')"), "u",
)


@query("note_biomarkers_flowsheet", with_views("noteevents") + _FLOWSHEET)
def note_biomarkers_flowsheet(spark, sf):
    return no.flowsheet_biomarkers(_notes(spark, sf))


def _fragment_sql(k: cat.DischargeFragment) -> str:
    clock = _first("m", r"^[\[\]0-9*-]+ ?([0-9:]+ ?[ap]?)") if k.use_clock else "NULL::VARCHAR"
    return f"""SELECT {_KEYS}, {k.itemid} AS i, '{k.unit}' AS u, {_first('m', k.value)} AS v,
        {_first('m', r'^([\[\]0-9*-]+)')} AS day, {clock} AS clock, {k.fallback_hours} AS late
        FROM (SELECT {_KEYS}, unnest({_all('note', k.fragment)}) AS m FROM {_note(cat.DISCHARGE)})"""


def _discharge_lockstep_sql(f: cat.Finding) -> str:
    return f"""SELECT {_KEYS}, {f.itemid} AS i, '{f.unit}' AS u, v,
        CASE WHEN length(translate(near, '[]*', '')) > 7 THEN near ELSE later END AS day, NULL::VARCHAR AS clock, 0 AS late
        FROM (SELECT {_KEYS}, unnest(a) AS v, unnest(b) AS near, unnest(c) AS later
              FROM (SELECT {_KEYS}, {_all('note', f.pattern)} AS a, {_all('note', cat.PERTINENT_DATE)} AS b,
                           {_all('note', cat.PERTINENT_DATE_LATER)} AS c FROM {_note(cat.DISCHARGE)}))"""


_DISCHARGE = _events(
    _union(
        [_fragment_sql(k) for k in cat.DISCHARGE_FRAGMENTS]
        + [_discharge_lockstep_sql(f) for f in cat.DISCHARGE_LOCKSTEP]
        + [f"""SELECT {_KEYS}, 51091, 'ng/ml', unnest({_all('note', cat.DISCHARGE_MB.pattern)}), NULL, NULL, 2
               FROM {_note(cat.DISCHARGE)}"""]
    ),
    f"coalesce(CASE WHEN length({_CLEAN_DAY}) > 7 THEN {_stamp(_CLEAN_DAY, 'clock')} END, chartdate + INTERVAL (late) HOUR)",
    "i", _num("replace(v, ':', '')"), "u",
)


@query("note_discharge_biomarkers", with_views("noteevents") + _DISCHARGE)
def note_discharge_biomarkers(spark, sf):
    return no.discharge_biomarkers(_notes(spark, sf))


def _nutrition_sql(lab: cat.NutritionLab) -> str:
    fixed = f"'{lab.unit}'" if lab.unit else "NULL"
    return f"""SELECT {_KEYS}, {lab.itemid} AS i, {fixed} AS fixed, m[{len(lab.literal) + 1}:] AS rest
        FROM (SELECT {_KEYS}, unnest({_all('note', lab.pattern)}) AS m FROM {_note(cat.NUTRITION)})"""


_REST_DAY = _first("rest", r"([\[*]*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[*\]]*)")
_REST_CLOCK = _first("rest", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[*\]]* ?([0-9:]+ ?[ap]?)")
_NUTRITION = _events(
    f"""SELECT {_KEYS}, i, {_num(_first('rest', r'^ ?([0-9]+(?:[.][0-9]+)?)'))} AS v,
        coalesce(fixed, {_first('rest', r'^ ?[0-9:]+(?:.[0-9:]+)? ?([a-z:/%]+)')}) AS u, translate({_REST_DAY}, '[]*', '') AS day,
        {_REST_CLOCK} AS clock FROM ({_union([_nutrition_sql(lab) for lab in cat.NUTRITION_LABS])})""",
    f"coalesce({_stamp('day', 'clock')}, chartdate)", "i", "v", "u",
)


@query("note_nutrition_labs", with_views("noteevents") + _NUTRITION)
def note_nutrition_labs(spark, sf):
    return no.nutrition_labs(_notes(spark, sf))


# --- troponin variants --------------------------------------------------------------------


def _greatest_sql(category: str, text: str, patterns, clock: str) -> str:
    best = "greatest(" + ", ".join(_first(text, p) for p in patterns) + ")"
    return f"""SELECT {_KEYS}, {best} AS v, {clock} AS clock
        FROM (SELECT {_KEYS}, {_squeezed('text')} AS cased, lower({_squeezed('text')}) AS low
              FROM noteevents WHERE category = '{category}')"""


_GREATEST = _events(
    _union(
        [_greatest_sql(c, "low", p, "NULL::VARCHAR") for c, p in cat.TROPONIN_GREATEST.items()]
        + [_greatest_sql(cat.PHYSICIAN, "cased", cat.TROPONIN_PHYSICIAN_CASED, _first("cased", cat.FLOWSHEET_TIME_CASED))]
    ),
    _on_day("clock"), "227429", _num("translate(v, '><^#q', '')"), "'ng/ml'",
)


@query("note_troponin_greatest", with_views("noteevents") + _GREATEST)
def note_troponin_greatest(spark, sf):
    return no.troponin_greatest(_notes(spark, sf))


def _physician_sql(pattern: str, late: int) -> str:
    return f"""SELECT {_KEYS}, unnest(a) AS v, unnest(d) AS day, unnest(c) AS clock, {late} AS late
        FROM (SELECT {_KEYS}, {_all('note', pattern)} AS a, {_all('note', cat.FLOWSHEET_DATE)} AS d,
                     {_all('note', cat.FLOWSHEET_TIME)} AS c FROM {_note(cat.PHYSICIAN)})"""


_PHYSICIAN = "SELECT * FROM (" + _events(
    _union([_physician_sql(cat.TROPONIN_PHYSICIAN_PLAIN, 0), _physician_sql(cat.TROPONIN_PHYSICIAN_TRIPLE, 1)]),
    f"coalesce(CASE WHEN length(clock) > 0 THEN {_stamp(_CLEAN_DAY, 'clock')} + INTERVAL (late) HOUR END, chartdate)",
    "227429", _num("translate(v, ':\"', '')"), "'ng/ml'",
) + ") WHERE VALUE < 100"


@query("note_troponin_physician", with_views("noteevents") + _PHYSICIAN)
def note_troponin_physician(spark, sf):
    return no.troponin_physician(_notes(spark, sf))


_DISCHARGE_TROPONIN = _events(
    f"""SELECT {_KEYS}, CASE WHEN x <> '' THEN {_num("split_part(c, ' ', 1)")}
             ELSE greatest({_num("replace(bare, ':', '')")}, {_num("replace(prose, ':', '')")}) END AS v,
        CASE WHEN x <> '' THEN coalesce({_stamp('full_day', "split_part(c, ' ', 3)")}, chartdate)
             ELSE chartdate + INTERVAL 1 HOUR END AS t
        FROM (SELECT *, translate(x, '[]*', '') AS c, split_part(translate(x, '[]*', ''), ' ', 2) AS p,
                     CASE WHEN length(split_part(p, '-', 1)) < 4
                          THEN year(chartdate) || '-' || lpad(split_part(p, '-', 1), 2, '0') || '-' || lpad(split_part(p, '-', 2), 2, '0')
                          ELSE p END AS full_day
              FROM (SELECT {_KEYS}, unnest(a) AS x, unnest(b) AS bare, unnest(d) AS prose
                    FROM (SELECT {_KEYS}, {_all('note', cat.TROPONIN_DISCHARGE_DATED)} AS a,
                                 {_all('note', cat.TROPONIN_DISCHARGE_BARE)} AS b,
                                 {_all('note', cat.TROPONIN_DISCHARGE_PROSE)} AS d FROM {_note(cat.DISCHARGE)})))""",
    "t", "227429", "v", "'ng/ml'",
)


@query("note_troponin_discharge", with_views("noteevents") + _DISCHARGE_TROPONIN)
def note_troponin_discharge(spark, sf):
    return no.troponin_discharge(_notes(spark, sf))


@query("note_troponin_all", with_views("noteevents") + _union(
    [f"SELECT * FROM ({s})" for s in (_GREATEST, _PHYSICIAN, _DISCHARGE_TROPONIN)], "UNION"))
def note_troponin_all(spark, sf):
    return no.troponin_all(_notes(spark, sf))


# --- fact table, survey -------------------------------------------------------------------


_OWN_NOTES = f"SELECT * FROM ({sql_view('noteevents')}) WHERE {IN_COHORT}"


@query("notes_fact", with_views("diagnoses_icd", cohort=STEMI, noteevents=_OWN_NOTES) + _union(
    [f"SELECT * FROM ({s})" for s in (_ECHO, _INFUSIONS, _MEDICATIONS, _DISCHARGE, _FLOWSHEET, _NUTRITION)], "UNION"))
def notes_fact(spark, sf):
    return no.note_events(_notes(spark, sf), stemi(spark, sf))


def _survey_sql(category: str, name: str, pattern: str) -> str:
    return f"""SELECT '{category}' AS category, '{name}' AS pattern, len(regexp_extract_all(note, {_q(pattern)})) AS hits
        FROM {_note(category)}"""


_SURVEYED = (
    [(cat.DISCHARGE, f"fragment_{i:02d}", k.fragment) for i, k in enumerate(cat.DISCHARGE_FRAGMENTS, 1)]
    + [(cat.DISCHARGE, f"lockstep_{i:02d}", f.pattern) for i, f in enumerate(cat.DISCHARGE_LOCKSTEP, 1)]
    + [(cat.DISCHARGE, "mb_index", cat.DISCHARGE_MB.pattern)]
    + [(cat.NUTRITION, lab.literal, lab.pattern) for lab in cat.NUTRITION_LABS]
)


@query("note_pattern_survey", with_views("noteevents") + f"""
    SELECT category, pattern, CAST(sum(hits) AS BIGINT) AS matches, count(CASE WHEN hits > 0 THEN 1 END) AS notes_with_match
    FROM ({_union([_survey_sql(*s) for s in _SURVEYED])}) GROUP BY category, pattern""")
def note_pattern_survey(spark, sf):
    return no.pattern_survey(_notes(spark, sf))

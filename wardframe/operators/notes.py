"""Structured events from free-text notes.

Every extractor is one narrow projection over the notes: all patterns of a category are
tried while a note is in hand, findings of one common form are exploded to rows, and no shuffle
happens before the single duplicate elimination of the fact table. The fact table reads the
notes once for all extractors.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.functions import text as tx
from wardframe.functions import times as tm
from wardframe.operators.cohort import of_cohort
from wardframe.operators.relations import union_distinct
from wardframe.sources import note_catalogue as cat

EVENT_IDS = ("subject_id", "hadm_id", "chartdate")
_INFUSION_CATEGORIES = (cat.GENERAL, cat.CONSULT)


def cohort_notes(notes: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Notes of the cohort that are not flagged as errors."""
    wanted = (*EVENT_IDS, "category", "description", "text")
    kept = of_cohort(notes.filter(F.col("iserror").isNull()), cohort)
    return kept.select(*[F.col(c).alias(c.upper()) for c in wanted])


def _of_categories(notes: DataFrame, *categories: str) -> DataFrame:
    return notes.filter(F.col("category").isin(*categories))


def _as_events(df: DataFrame, time: Column, item: Column, value: Column, unit: Column) -> DataFrame:
    """Canonical event columns; a value that is not positive is no measurement."""
    return df.select(
        F.col("subject_id").alias("SUBJECT_ID"),
        F.col("hadm_id").alias("HADM_ID"),
        F.col("chartdate").alias("CHARTDATE"),
        time.alias("CHARTTIME"),
        item.cast("int").alias("ITEMID"),
        value.cast("double").alias("VALUE"),
        unit.alias("VALUEUOM"),
    ).filter(F.col("VALUE") > 0)


#: What every extractor finds, so that all can leave one projection through one generator. ``number`` or
#: its text ``digits``; with a ``day`` the time is read from day and clock, else the clock is put on the chart date.
_FOUND = "struct<itemid: int, unit: string, number: double, digits: string, dated: boolean, day: string, clock: string, late: int>"
_NOTHING = f"array<{_FOUND}>"


def _found(
    itemid: int, unit: Column | str, number: Column | None = None, digits: Column | None = None,
    day: Column | None = None, clock: Column | None = None, late: int = 0, dated: bool = False,
) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(itemid).alias("itemid"), (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"),
        (F.lit(None).cast("double") if number is None else number).alias("number"), (text if digits is None else digits).alias("digits"),
        F.lit(dated).alias("dated"), (text if day is None else day).alias("day"), (text if clock is None else clock).alias("clock"),
        F.lit(late).alias("late"),
    )


def _found_events(notes: DataFrame, *found: Column, clocked: bool, dated: bool) -> DataFrame:
    """Events of the findings of a note; ``clocked`` and ``dated`` tell which kinds can occur."""
    rows = notes.select(*EVENT_IDS, F.inline(F.concat(*found) if len(found) > 1 else found[0]))
    chart = F.col("chartdate")
    value = F.coalesce("number", tx.to_number(F.col("digits"))) if dated else F.col("number")
    time = tm.clock_on_day(chart, F.col("clock"))
    if dated:
        date = tx.drop_chars(F.col("day"), "[]*")
        stamp = F.when(F.length(date) > 7, tm.clinical_timestamp(date, F.col("clock")))
        fallback = F.when(F.col("late") == 2, chart + tm.hours(2)).otherwise(chart)
        read = F.coalesce(stamp, fallback)
        time = F.when(F.col("dated"), read).otherwise(time) if clocked else read
    return _as_events(rows, time, F.col("itemid"), value, F.col("unit"))


# --- echo reports -----------------------------------------------------------------------


def _echo_found() -> Column:
    text = F.col("text")
    clock = tx.first_or_blank(text, cat.ECHO_TIME, needs="Date/Time: ")

    def number(finding: cat.Finding) -> Column:
        return tx.to_number(tx.first_or_blank(text, finding.pattern, needs=finding.needs))

    def inside(value: Column, low: float, high: float) -> Column:
        return F.when((value > low) & (value < high), value)

    values = (
        (cat.ECHO_HEIGHT, inside(number(cat.ECHO_HEIGHT) * 2.54, 100, 240)),
        (cat.ECHO_WEIGHT, inside(number(cat.ECHO_WEIGHT) * 0.45, 50, 250)),
        (cat.ECHO_SYSTOLIC, number(cat.ECHO_SYSTOLIC)),
        (cat.ECHO_DIASTOLIC, number(cat.ECHO_DIASTOLIC)),
        (cat.ECHO_HEART_RATE, number(cat.ECHO_HEART_RATE)),
    )
    return F.array(*[_found(f.itemid, f.unit, v, clock=clock) for f, v in values])


def echo_vitals(notes: DataFrame) -> DataFrame:
    """Height, weight, blood pressure and heart rate of echo reports."""
    own = _of_categories(notes, cat.ECHO).filter(F.col("hadm_id").isNotNull())
    return _found_events(own, _echo_found(), clocked=True, dated=False)


# --- infusions --------------------------------------------------------------------------


def _infusions_found() -> Column:
    text = F.col("text")
    clock = tx.first_or_blank(text, cat.FLOWSHEET_TIME_RAW, needs="Flowsheet Data as of")

    def candidate(infusion: cat.Infusion) -> Column:
        line = tx.first_or_blank(text, rf"{infusion.label} - (.*?)\n", needs=f"{infusion.label} - ")
        amount = tx.to_number(F.replace(tx.split_token(line, " ", 1), F.lit(","), F.lit("")))
        fits = F.lower(tx.split_token(line, " ", 2)) == infusion.rate_unit
        here = F.col("category") == infusion.category
        value = F.when(here & fits if infusion.strict_unit else here, amount)
        return _found(infusion.itemid, F.when(fits, F.lit(infusion.unit)), value, clock=clock)

    return F.array(*[candidate(i) for i in cat.INFUSIONS])


def infusion_rates(notes: DataFrame) -> DataFrame:
    """Insulin, heparin and amiodarone rates; ``1,050 units/hour`` style.

    Where the unit is strict a rate in another unit is dropped, elsewhere it keeps its
    value and loses its unit.
    """
    return _found_events(_of_categories(notes, *_INFUSION_CATEGORIES), _infusions_found(), clocked=True, dated=False)


# --- medications ------------------------------------------------------------------------


def _dose(low: Column, drug: cat.Medication) -> Column:
    first = tx.first_present(*[tx.first_or_blank(low, p, needs=drug.needs(p)) for p in drug.doses])
    value = tx.to_number(F.replace(first, F.lit(":"), F.lit("")))
    return F.when(value > 1000, value / 1000).otherwise(value) if drug.rescale else value


def _clock(low: Column, drug: cat.Medication) -> Column:
    digits = F.array(*[
        F.replace(tx.first_or_blank(low, p, needs=drug.needs(p)), F.lit(":"), F.lit(""))
        for p in drug.clocks
    ])
    return F.try_element_at(F.filter(digits, lambda d: F.length(d) == 4), F.lit(1))


def _medications_found(drugs: Sequence[cat.Medication]) -> Column:
    low = F.col("low")
    return F.array_compact(F.array(*[
        F.when(
            F.greatest(*[F.contains(low, F.lit(n)) for n in d.names]) if len(d.names) > 1 else F.contains(low, F.lit(d.names[0])),
            _found(d.itemid, "mg", _dose(low, d), clock=_clock(low, d)),
        )
        for d in drugs
    ]))


def medication_doses(notes: DataFrame, drugs: Sequence[cat.Medication] = cat.MEDICATIONS) -> DataFrame:
    """Dose per drug and note: the first pattern in priority order that finds a number.

    A drug whose name is not in the text costs one substring test per pattern.
    """
    own = _of_categories(notes, *cat.MEDICATION_CATEGORIES).select(*EVENT_IDS, F.lower("text").alias("low"))
    return _found_events(own, _medications_found(drugs), clocked=True, dated=False)


# --- biomarkers in flowsheet notes -------------------------------------------------------


def _normalised(notes: DataFrame, *categories: str) -> DataFrame:
    return _of_categories(notes, *categories).select(
        *EVENT_IDS, "category", tx.normalise_note(F.col("text")).alias("note")
    )


def _flowsheet_dates() -> dict[str, Column]:
    note = F.col("note")
    return {
        "days": tx.all_matches(note, cat.FLOWSHEET_DATE, needs="flowsheet data"),
        "clocks": tx.all_matches(note, cat.FLOWSHEET_TIME, needs="flowsheet data"),
    }


def _flowsheet_found() -> list[Column]:
    note = F.col("note")

    def readings(finding: cat.Finding) -> Column:
        values = tx.all_matches(note, finding.pattern, needs=finding.needs)
        if finding.categories:
            values = F.when(F.col("category").isin(*finding.categories), values).otherwise(
                F.array().cast("array<string>")
            )
        zipped = F.arrays_zip(values.alias("value"), F.col("days").alias("day"), F.col("clocks").alias("clock"))
        return F.transform(zipped, lambda z: _found(
            finding.itemid, finding.unit, digits=tx.drop_chars(z["value"], ":/"), day=z["day"], clock=z["clock"], dated=True
        ))

    return [readings(f) for f in cat.FLOWSHEET_BIOMARKERS]


def flowsheet_biomarkers(
    notes: DataFrame, categories: Sequence[str] = cat.FLOWSHEET_CATEGORIES
) -> DataFrame:
    """Troponin, CK-MB, CK and MB: the i-th value goes with the i-th flowsheet date and
    clock of the note (missing partners are NULL)."""
    own = _normalised(notes, *categories).withColumns(_flowsheet_dates())
    return _found_events(own, *_flowsheet_found(), clocked=False, dated=True)


# --- discharge summaries ----------------------------------------------------------------


def _discharge_dates() -> dict[str, Column]:
    note = F.col("note")
    return {
        "near": tx.all_matches(note, cat.PERTINENT_DATE, needs="pertinent results"),
        "later": tx.all_matches(note, cat.PERTINENT_DATE_LATER, needs="pertinent results"),
    }


def _discharge_found() -> list[Column]:
    note = F.col("note")

    def digits(value: Column) -> Column:
        return F.replace(value, F.lit(":"), F.lit(""))

    def fragments(kind: cat.DischargeFragment) -> Column:
        return F.transform(tx.all_matches(note, kind.fragment, needs=kind.needs), lambda m: _found(
            kind.itemid, kind.unit, digits=digits(tx.first_or_blank(m, kind.value)),
            day=tx.first_or_blank(m, r"^([\[\]0-9*-]+)"),
            clock=tx.first_or_blank(m, r"^[\[\]0-9*-]+ ?([0-9:]+ ?[ap]?)") if kind.use_clock else None,
            late=kind.fallback_hours, dated=True,
        ))

    def lockstep(finding: cat.Finding) -> Column:
        zipped = F.arrays_zip(
            tx.all_matches(note, finding.pattern, needs=finding.needs).alias("value"),
            F.col("near").alias("near"), F.col("later").alias("later"),
        )
        return F.transform(zipped, lambda z: _found(
            finding.itemid, finding.unit, digits=digits(z["value"]), dated=True,
            day=F.coalesce(F.when(F.length(tx.drop_chars(z["near"], "[]*")) > 7, z["near"]), z["later"]),
        ))

    bare = F.transform(
        tx.all_matches(note, cat.DISCHARGE_MB.pattern, needs=cat.DISCHARGE_MB.needs),
        lambda m: _found(cat.DISCHARGE_MB.itemid, cat.DISCHARGE_MB.unit, digits=digits(m), late=2, dated=True),
    )
    return [*[fragments(k) for k in cat.DISCHARGE_FRAGMENTS], *[lockstep(f) for f in cat.DISCHARGE_LOCKSTEP], bare]


def discharge_biomarkers(notes: DataFrame) -> DataFrame:
    """CK-MB, CK, troponin and MB index of discharge summaries.

    Fragments hold date, clock and value of one reading; the value, date and clock are
    then read from the short fragment. The looser patterns take the date after
    "pertinent results" in lock step, the bare MB index takes chart date + 2 h.
    """
    own = _normalised(notes, cat.DISCHARGE).withColumns(_discharge_dates())
    return _found_events(own, *_discharge_found(), clocked=False, dated=True)


# --- nutrition notes --------------------------------------------------------------------


def _nutrition_found() -> list[Column]:
    note = F.col("note")

    def readings(lab: cat.NutritionLab) -> Column:
        def reading(m: Column) -> Column:
            rest = F.substring(m, F.lit(len(lab.literal) + 1), F.length(m))
            unit = F.nullif(tx.first_or_blank(rest, r"^ ?[0-9:]+(?:.[0-9:]+)? ?([a-z:/%]+)"), F.lit(""))
            return _found(
                lab.itemid, F.coalesce(F.lit(lab.unit), unit), digits=tx.first_or_blank(rest, r"^ ?([0-9]+(?:\.[0-9]+)?)"),
                day=tx.first_or_blank(rest, r"([\[*]*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[*\]]*)"),
                clock=tx.first_or_blank(rest, r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[*\]]* ?([0-9:]+ ?[ap]?)"), dated=True,
            )

        return F.transform(tx.all_matches(note, lab.pattern, needs=lab.literal), reading)

    return [readings(lab) for lab in cat.NUTRITION_LABS]


def nutrition_labs(notes: DataFrame) -> DataFrame:
    """Laboratory values quoted as "name value unit date clock"; duplicates are kept."""
    return _found_events(_normalised(notes, cat.NUTRITION), *_nutrition_found(), clocked=False, dated=True)


# --- troponin variants ------------------------------------------------------------------


def troponin_greatest(notes: DataFrame) -> DataFrame:
    """Largest (as text) of several troponin readings of a note.

    Physician notes are matched case-sensitively and carry the flowsheet clock; other
    categories keep the chart date. The readings leave through a generator, so the filter
    on the value cannot be pushed into a second evaluation of all patterns.
    """
    squeezed = tx.squeeze_blanks(tx.flatten_lines(F.col("text")))
    low, cased = F.col("low"), F.col("squeezed")
    category = F.col("category")
    best = F.when(
        category == cat.PHYSICIAN,
        tx.text_max(*[tx.first_or_blank(cased, p) for p in cat.TROPONIN_PHYSICIAN_CASED]),
    )
    for name, patterns in cat.TROPONIN_GREATEST.items():
        best = best.when(
            category == name, tx.text_max(*[tx.first_or_blank(low, p) for p in patterns])
        )
    clock = F.when(
        category == cat.PHYSICIAN,
        tx.first_or_blank(cased, cat.FLOWSHEET_TIME_CASED, needs="Flowsheet Data as of"),
    )
    rows = (
        _of_categories(notes, cat.PHYSICIAN, *cat.TROPONIN_GREATEST)
        .select(*EVENT_IDS, "category", squeezed.alias("squeezed"))
        .filter(F.contains(F.lower("squeezed"), F.lit("trop")))
        .select(*EVENT_IDS, "category", "squeezed", F.lower("squeezed").alias("low"))
        .select(*EVENT_IDS, F.inline(F.array(F.struct(best.alias("value"), clock.alias("clock")))))
    )
    return _as_events(
        rows, tm.clock_on_day(F.col("chartdate"), F.col("clock")), F.lit(cat.TROPONIN_ITEM),
        tx.to_number(tx.drop_chars(F.col("value"), "><^#q")), F.lit(cat.TROPONIN_UNIT),
    )


def troponin_physician(notes: DataFrame) -> DataFrame:
    """Plain and triple troponin readings of physician notes in (0, 100), in lock step with
    flowsheet date and clock; the triple form is one hour later."""
    note = F.col("note")

    def readings(pattern: str, late: int) -> Column:
        zipped = F.arrays_zip(
            tx.all_matches(note, pattern, needs="trop").alias("value"),
            tx.all_matches(note, cat.FLOWSHEET_DATE, needs="flowsheet data").alias("day"),
            tx.all_matches(note, cat.FLOWSHEET_TIME, needs="flowsheet data").alias("clock"),
        )
        return F.transform(
            zipped,
            lambda z: F.struct(
                z["value"].alias("value"), z["day"].alias("day"), z["clock"].alias("clock"),
                F.lit(late).alias("late"),
            ),
        )

    rows = _normalised(notes, cat.PHYSICIAN).select(
        *EVENT_IDS,
        F.inline(F.concat(
            readings(cat.TROPONIN_PHYSICIAN_PLAIN, 0), readings(cat.TROPONIN_PHYSICIAN_TRIPLE, 1)
        )),
    )
    value = tx.to_number(tx.drop_chars(F.col("value"), ':"'))
    stamp = tm.clinical_timestamp(tx.drop_chars(F.col("day"), "[]*"), F.col("clock"))
    shifted = F.when(F.col("late") == 1, stamp + tm.hours(1)).otherwise(stamp)
    time = F.coalesce(F.when(F.length("clock") > 0, shifted), F.col("chartdate"))
    events = _as_events(rows, time, F.lit(cat.TROPONIN_ITEM), value, F.lit(cat.TROPONIN_UNIT))
    return events.filter(F.col("VALUE") < 100)


def troponin_discharge(notes: DataFrame) -> DataFrame:
    """Troponin of discharge summaries: dated readings first, else the largest undated one
    at chart date + 1 h. A date without year takes the year of the chart date."""
    note = F.col("note")
    zipped = F.arrays_zip(
        tx.all_matches(note, cat.TROPONIN_DISCHARGE_DATED, needs="trop").alias("dated"),
        tx.all_matches(note, cat.TROPONIN_DISCHARGE_BARE, needs="trop").alias("bare"),
        tx.all_matches(note, cat.TROPONIN_DISCHARGE_PROSE, needs="trop").alias("prose"),
    )
    rows = _normalised(notes, cat.DISCHARGE).select(*EVENT_IDS, F.inline(zipped))
    clean = tx.drop_chars(F.col("dated"), "[]*")
    day = tm.yearless_date(tx.split_token(clean, " ", 2), F.col("chartdate"))
    dated_time = F.coalesce(
        tm.clinical_timestamp(day, tx.split_token(clean, " ", 3)), F.col("chartdate")
    )
    undated = F.greatest(
        tx.to_number(F.replace("bare", F.lit(":"), F.lit(""))),
        tx.to_number(F.replace("prose", F.lit(":"), F.lit(""))),
    )
    is_dated = F.length("dated") > 0
    value = F.when(is_dated, tx.to_number(tx.split_token(clean, " ", 1))).otherwise(undated)
    time = F.when(is_dated, dated_time).otherwise(F.col("chartdate") + tm.hours(1))
    return _as_events(rows, time, F.lit(cat.TROPONIN_ITEM), value, F.lit(cat.TROPONIN_UNIT))


def troponin_all(notes: DataFrame) -> DataFrame:
    return union_distinct(troponin_greatest(notes), troponin_physician(notes), troponin_discharge(notes))


# --- fact table and survey --------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _fact_columns(application: str) -> tuple[dict[str, Column], dict[str, Column], list[Column]]:
    """Columns of the fact table's projection: texts, dates, findings. Several hundred expressions,
    therefore made once for an application."""
    category = F.col("category")

    def only(categories: Sequence[str], column: Column) -> Column:
        return F.when(category.isin(*categories), column)

    def findings(categories: Sequence[str], *found: Column, where: Column | None = None) -> Column:
        here = category.isin(*categories) if where is None else category.isin(*categories) & where
        return F.when(here, F.concat(*found) if len(found) > 1 else found[0]).otherwise(F.array().cast(_NOTHING))

    normal = (*cat.FLOWSHEET_CATEGORIES, cat.DISCHARGE, cat.NUTRITION)
    texts = {"low": only(cat.MEDICATION_CATEGORIES, F.lower("text")), "note": only(normal, tx.normalise_note(F.col("text")))}
    dates = {n: only(cat.FLOWSHEET_CATEGORIES, c) for n, c in _flowsheet_dates().items()}
    dates |= {n: only((cat.DISCHARGE,), c) for n, c in _discharge_dates().items()}
    found = [
        findings((cat.ECHO,), _echo_found(), where=F.col("hadm_id").isNotNull()),
        findings(_INFUSION_CATEGORIES, _infusions_found()),
        findings(cat.MEDICATION_CATEGORIES, _medications_found(cat.MEDICATIONS)),
        findings(cat.FLOWSHEET_CATEGORIES, *_flowsheet_found()),
        findings((cat.DISCHARGE,), *_discharge_found()),
        findings((cat.NUTRITION,), *_nutrition_found()),
    ]
    return texts, dates, found


def note_events(notes: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """All structured note events from one scan of the notes.

    The category of a note decides which texts are prepared and which patterns are tried; all findings
    leave through one generator. Duplicates are removed once.
    """
    texts, dates, found = _fact_columns(notes.sparkSession.sparkContext.applicationId)
    read = (*cat.MEDICATION_CATEGORIES, *cat.FLOWSHEET_CATEGORIES, cat.ECHO, cat.DISCHARGE, cat.NUTRITION)
    own = _of_categories(of_cohort(notes, cohort), *dict.fromkeys(read)).select(*EVENT_IDS, "category", "text")
    return _found_events(own.withColumns(texts).withColumns(dates), *found, clocked=True, dated=True).distinct()


def pattern_survey(notes: DataFrame) -> DataFrame:
    """How often each discharge and nutrition pattern matches, and in how many notes."""
    note = F.col("note")
    named = [
        (cat.DISCHARGE, f"fragment_{i:02d}", k.fragment, k.needs)
        for i, k in enumerate(cat.DISCHARGE_FRAGMENTS, 1)
    ]
    named += [
        (cat.DISCHARGE, f"lockstep_{i:02d}", f.pattern, f.needs)
        for i, f in enumerate(cat.DISCHARGE_LOCKSTEP, 1)
    ]
    named.append((cat.DISCHARGE, "mb_index", cat.DISCHARGE_MB.pattern, cat.DISCHARGE_MB.needs))
    named += [(cat.NUTRITION, lab.literal, lab.pattern, lab.literal) for lab in cat.NUTRITION_LABS]
    counts = F.array(*[
        F.struct(
            F.lit(name).alias("pattern"),
            F.when(F.col("category") == kind, tx.match_count(note, regex, needs)).alias("hits"),
        )
        for kind, name, regex, needs in named
    ])
    return (
        _normalised(notes, cat.DISCHARGE, cat.NUTRITION)
        .select("category", F.inline(counts))
        .filter(F.col("hits").isNotNull())
        .groupBy("category", "pattern")
        .agg(
            F.sum("hits").alias("matches"),
            F.count(F.when(F.col("hits") > 0, 1)).alias("notes_with_match"),
        )
    )

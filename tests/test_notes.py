"""Golden note snippets."""

import datetime

import pytest
from pyspark.sql import functions as F

from wardframe.functions import text as tx
from wardframe.functions import times as tm
from wardframe.operators import notes as no
from wardframe.sources.schemas import TABLES

DAY = datetime.datetime(2100, 2, 3)


def note(spark, category, text):
    return spark.createDataFrame([(1, 10, DAY, category, None, text, None)], TABLES["noteevents"])


def values(df):
    return sorted((r.ITEMID, r.VALUE, r.VALUEUOM) for r in df.collect())


def test_echo(spark):
    text = "Height: (in) 70\nWeight (lb): 180\nBP (mm Hg): 120/80\nHR (bpm): 72\n"
    got = values(no.echo_vitals(note(spark, "Echo", text)))
    assert [(i, round(v, 6), u) for i, v, u in got] == [
        (51, 120.0, "mmHg"), (211, 72.0, "bpm"), (8368, 80.0, "mmHg"), (226730, 177.8, "cm"), (226846, 81.0, "kg"),
    ]


def test_infusions(spark):
    text = "Insulin - Regular - 3 units/hour\nHeparin Sodium - 1,050 units/hour\nAmiodarone - 1 mL/hour\n"
    assert values(no.infusion_rates(note(spark, "General", text))) == [(217, 1050.0, "unit"), (30045, 3.0, "unit")]


@pytest.mark.parametrize(
    ("text", "value"),
    [("TropT 0.38", 0.38), ("Troponin T <0.01", 0.01), ("Troponin-T:51//<0.01", 0.01), ("Troponin T:167/4/0.05", 0.05),
     ("Troponin-T:250/31/0.36", 0.36)],
)
def test_physician_troponin(spark, text, value):
    assert values(no.troponin_greatest(note(spark, "Physician ", text))) == [(227429, value, "ng/ml")]


def test_nursing_troponin_full_number(spark):
    got = values(no.flowsheet_biomarkers(note(spark, "Nursing", "troponin 0.36")))
    assert got == [(227429, 0.36, "ng/ml")]


def test_medications(spark):
    rows = no.medication_doses(note(spark, "Nursing", "Lisinopril 5 mg, captopril to 25. aspirin 325000 given")).collect()
    assert sorted((r.ITEMID, r.VALUE) for r in rows) == [(3349, 25.0), (7325, 325.0), (65374, 5.0)]
    assert {r.CHARTTIME for r in rows} == {DAY}
    timed = no.medication_doses(note(spark, "Nursing", "started on lisinopril 5mg - given at 0830 lisinopril 10")).first()
    assert (timed.VALUE, timed.CHARTTIME) == (5.0, datetime.datetime(2100, 2, 3, 8, 30))


def test_nutrition(spark):
    row = no.nutrition_labs(note(spark, "Nutrition", "Glucose 150 mg/dL [**2100-1-1**] 05:30 AM")).first()
    assert (row.ITEMID, row.VALUE, row.VALUEUOM) == (50809, 150.0, "mg/dl")
    assert row.CHARTTIME == datetime.datetime(2100, 1, 1, 5, 30)


def test_lockstep_pads_with_null(spark):
    text = "flowsheet data as of [**2100-1-5**] 06:10 ck 250 then ck 300"
    rows = no.flowsheet_biomarkers(note(spark, "Nursing", text)).collect()
    assert sorted((r.VALUE, r.CHARTTIME) for r in rows) == [
        (250.0, datetime.datetime(2100, 1, 5, 6, 10)), (300.0, DAY),
    ]


def test_squeeze_is_literal(spark):
    df = spark.createDataFrame([("a   b *c ^*d",)], "t string")
    assert df.select(tx.squeeze_blanks(F.col("t"))).first()[0] == "a   b *c ^*d".replace(" ", "*^").replace("^*", "").replace("*^", " ")


@pytest.mark.parametrize(
    ("day", "clock", "want"),
    [("[**2100-1-1**]", "1:23am", (2100, 1, 1, 1, 23)), ("2100-1-1", "12:05a", (2100, 1, 1, 0, 5)),
     ("2100-1-1", "430pm", (2100, 1, 1, 16, 30)), ("2100-1-1", "", (2100, 1, 1)), ("1-1", "05:00", None)],
)
def test_lenient_timestamp(spark, day, clock, want):
    df = spark.createDataFrame([(day, clock)], "d string, c string")
    got = df.select(tm.clinical_timestamp(F.col("d"), F.col("c"))).first()[0]
    assert got == (datetime.datetime(*want) if want else None)


def test_text_max_is_lexicographic(spark):
    df = spark.createDataFrame([("9", "10", None)], "a string, b string, c string")
    assert df.select(tx.text_max(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "9"


def test_fact_table_reads_the_notes_once(spark):
    from wardframe.plans import note_queries

    notes = note_queries._notes(spark, "/root/testdata/sf0.001")
    plan = no.note_events(notes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1
    once = no.note_events(notes).collect()
    parts = [f(notes) for f in (no.echo_vitals, no.infusion_rates, no.medication_doses, no.discharge_biomarkers, no.flowsheet_biomarkers, no.nutrition_labs)]
    assert set(once) == {r for p in parts for r in p.collect()} and len(once) == len(set(once))


def test_spread_only_deals_tables_of_few_splits(spark, tmp_path):
    from wardframe.sources import readers

    spark.range(100).withColumn("k", F.col("id") % 7).coalesce(1).write.parquet(str(tmp_path / "one"))
    few = spark.read.parquet(str(tmp_path / "one"))
    dealt = readers.spread(few, "id")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, few.collect()))
    assert readers.spread(dealt) is dealt

"""Round trips through files: exports and the position-coded text formats.

Files go below the shared folder of the session. Sorted output is written by many tasks;
the readers put the parts in order by name and offset.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardframe.operators import cohort as co
from wardframe.operators import impute, metrics, scaling
from wardframe.plans import series_sql as sq
from wardframe.plans.inputs import source, spark_view
from wardframe.plans.registry import query, with_views
from wardframe.plans.series import (
    AMPUTATED,
    FEATURES,
    RATE,
    amputated,
    filled_scaled,
    grid48,
    mean_sql,
    predictions,
    r6,
    series12,
)
from wardframe.plans.structured import IN_COHORT, STEMI, stemi
from wardframe.session import cut_lineage, scratch_path
from wardframe.sources import readers, writers


@query("csv_export_roundtrip", with_views("diagnoses_icd", "icustays", cohort=STEMI) + f"""
    SELECT subject_id, hadm_id, icustay_id, dbsource, first_careunit, last_careunit, first_wardid, last_wardid,
           intime, outtime, los FROM icustays WHERE {IN_COHORT}""")
def csv_export_roundtrip(spark, sf):
    path = scratch_path(spark, "icustays")
    writers.export_csv(co.icu_stays(spark_view(spark, sf, "icustays"), stemi(spark, sf)), f"{path}/icustays.csv")
    return readers.read_table(spark, path, "icustays", "csv")


@query("notes_export_roundtrip", with_views("noteevents") + """
    SELECT subject_id, hadm_id, chartdate, category, md5(replace(text, chr(10), ' ')) AS digest FROM noteevents""")
def notes_export_roundtrip(spark, sf):
    path = scratch_path(spark, "notes")
    writers.export_notes(spark_view(spark, sf, "noteevents"), path)
    schema = "subject_id long, hadm_id long, chartdate timestamp_ntz, texto string, category string"
    back = spark.read.schema(schema).parquet(path)
    return back.select("subject_id", "hadm_id", "chartdate", "category", F.md5("texto").alias("digest"))


@query("scaler_roundtrip", sq.series_ctes("params") + "SELECT * FROM params")
def scaler_roundtrip(spark, sf):
    path = scratch_path(spark, "scaler")
    writers.save_scaler(scaling.fit_scaler(series12(spark, sf).filter(F.col("pid") % 5 < 4), FEATURES), path)
    return writers.load_scaler(spark, path)


@query("metric_lines", """
    SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, CAST(0 AS INT) AS token, value FROM events""")
def metric_lines(spark, sf):
    path = scratch_path(spark, "metric")
    source(spark, sf, "events").orderBy("event_id").select(F.col("value").cast("string")).write.text(path)
    return readers.read_metric_lines(spark, path)


@query("vector_roundtrip", sq.series_ctes("scaled") + """
    SELECT dense_rank() OVER (ORDER BY pid) - 1 AS patient, CAST(step - 6 AS INT) AS step, feature, round(coalesce(v, 0), 6) AS value
    FROM scaled WHERE step > 6""")
def vector_roundtrip(spark, sf):
    path = scratch_path(spark, "yreal")
    names = F.array(*[F.lit(f) for f in FEATURES])
    rows = filled_scaled(spark, sf).filter(F.col("step") > 6)
    ordered = rows.orderBy("pid", "step", F.array_position(names, F.col("feature")))
    ordered.select(F.coalesce("value", F.lit(0.0)).cast("string")).write.text(path)
    return r6(readers.read_vector(spark, path, FEATURES, 6), "value")


@query("external_series", sq.series_ctes("grid") + "SELECT pid, step, " + ", ".join(
    f'round("{f}", 6) AS "{f}"' for f in FEATURES) + " FROM grid")
def external_series(spark, sf):
    path = scratch_path(spark, "external")
    grid = grid48(spark, sf)
    index = F.lit(0).cast("long").alias("_c0")
    writers.export_csv(grid.orderBy("pid", "step").select(index, *FEATURES), f"{path}/samples")
    writers.export_csv(grid.select("pid").distinct().orderBy("pid").select(index, F.col("pid").alias("0")), f"{path}/pids")
    return r6(readers.read_external_series(spark, f"{path}/samples", f"{path}/pids", FEATURES, sq.STEPS), *FEATURES)


@query("imputed_export", sq.series_ctes("cells", amputated=AMPUTATED, imputed=mean_sql("amputated")) + f"""
    SELECT 'simple' AS method, {RATE} AS pct, pid, step, feature, round(imputed, 6) AS imputed FROM imputed""")
def imputed_export(spark, sf):
    path = scratch_path(spark, "imputed")
    filled = impute.fill_mean(amputated(spark, sf)).select(
        F.lit("simple").alias("method"), F.lit(RATE).alias("pct"), "pid", "step", "feature", "imputed"
    )
    writers.export_imputed(filled, path)
    return r6(spark.read.parquet(path).select(filled.columns), "imputed")


@query("vector_export", sq.series_ctes("scaled") + "SELECT pid, step, feature, round(v, 6) AS value FROM scaled")
def vector_export(spark, sf):
    path = scratch_path(spark, "vectors")
    writers.export_vector(filled_scaled(spark, sf), path)
    return r6(spark.read.parquet(path), "value")


@query("summary_export", sq.series_ctes("predictions") + """
    SELECT step, feature, round(avg(y), 6) AS real, round(avg(yhat), 6) AS predicted FROM predictions GROUP BY step, feature""")
def summary_export(spark, sf):
    path = scratch_path(spark, "summary")
    writers.export_summary(r6(metrics.dimension_means(predictions(spark, sf)), "real", "predicted"), path)
    return spark.read.schema("step int, feature string, real double, predicted double").json(path)


@query("published_stays", with_views("diagnoses_icd", "icustays", cohort=STEMI) + f"""
    SELECT first_careunit, count(*) AS stays FROM icustays WHERE {IN_COHORT} GROUP BY first_careunit""")
def published_stays(spark, sf):
    """A cohort published under a name and read back by SQL."""
    writers.publish(co.icu_stays(spark_view(spark, sf, "icustays"), stemi(spark, sf)), "cohort_stays")
    return spark.sql("SELECT first_careunit, count(*) AS stays FROM cohort_stays GROUP BY first_careunit")


@query("dropped_relations", with_views("icustays") + """
    SELECT first_careunit, count(*) AS stays, 'careunit_counts,careunit_stays,all_stays' AS dropped FROM icustays GROUP BY first_careunit""")
def dropped_relations(spark, sf):
    """A chain of three published relations; the last is read, then dropping the first drops its dependants before it."""
    writers.publish(spark_view(spark, sf, "icustays"), "all_stays")
    writers.publish(spark.sql("SELECT first_careunit, hadm_id FROM all_stays"), "careunit_stays")
    writers.publish(spark.sql("SELECT first_careunit, count(*) AS stays FROM careunit_stays GROUP BY first_careunit"), "careunit_counts")
    counts = cut_lineage(spark.table("careunit_counts"))
    return counts.withColumn("dropped", F.lit(",".join(writers.drop_relation(spark, "all_stays", cascade=True))))


@query("saved_table", with_views("icustays") + "SELECT first_careunit, count(*) AS stays, round(avg(los), 6) AS los FROM icustays GROUP BY first_careunit")
def saved_table(spark, sf):
    """``CREATE TABLE AS``: stays written as a table and queried by its name."""
    path = scratch_path(spark, "saved")
    name = "saved_" + path.rsplit("-", 1)[1]
    writers.save_table(spark_view(spark, sf, "icustays"), name, path)
    return spark.sql(f"SELECT first_careunit, count(*) AS stays, round(avg(los), 6) AS los FROM {name} GROUP BY first_careunit")

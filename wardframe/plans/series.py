"""Regular series, scaling, windows, sampling and imputation on the event table.

A patient is a user, a vital sign an event type. Forty-eight steps of fifteen hours cover
the whole month of events, so every row of the table takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardframe.operators import conditions as cd
from wardframe.operators import grid as gr
from wardframe.operators import experiment, impute, knn_impute, relations, regression_impute, sampling, scaling, windows
from wardframe.plans import series_sql as sq
from wardframe.plans.inputs import EVENT_TYPES, source, spark_view, sql_view
from wardframe.plans.registry import query, with_views
from wardframe.session import cut_lineage, scratch_path

FEATURES = EVENT_TYPES
RATE = 20
CELL = ["pid", "step", "feature"]


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _r6_sql(columns) -> str:
    return ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns)


# --- inputs of the chain -------------------------------------------------------------------


def grid48(spark, sf):
    return gr.series_grid(
        spark_view(spark, sf, "observations"), spark_view(spark, sf, "event_stays"), FEATURES, sq.HOURS, sq.STEPS
    )


def series12(spark, sf):
    return gr.bucket_mean(grid48(spark, sf), FEATURES, 4)


def cells12(spark, sf):
    return gr.to_long(series12(spark, sf), FEATURES)


def filled_scaled(spark, sf):
    """Interpolated cells scaled to (-1, 1) on the training patients; stored, as every use reads
    them for the scaler and for itself."""
    filled = cut_lineage(impute.fill_linear(cells12(spark, sf)))
    known = filled.withColumn("observed", F.col("value").isNotNull()).withColumn("value", F.col("imputed"))
    params = scaling.fit_cells(known.filter(F.col("pid") % 5 < 4))
    return scaling.scale_cells(known, params, ("value",), -1.0, 1.0).drop("imputed")


def predictions(spark, sf):
    """Seasonal-naive forecast: the target half is predicted by the history half."""
    from pyspark.sql import Window

    w = Window.partitionBy("pid", "feature").orderBy("step")
    rows = filled_scaled(spark, sf).withColumn("yhat", F.lag("value", 6).over(w))
    return rows.filter((F.col("step") > 6) & F.col("value").isNotNull()).select(
        "pid", "step", "feature", F.col("value").alias("y"), "yhat", "observed"
    )


# --- grid and scaling ----------------------------------------------------------------------


@query("hourly_grid", sq.series_ctes("grid") + f"SELECT pid, step, {_r6_sql(FEATURES)} FROM grid")
def hourly_grid(spark, sf):
    return r6(grid48(spark, sf), *FEATURES)


@query("bucket4_mean", sq.series_ctes("series") + "SELECT * FROM series")
def bucket4_mean(spark, sf):
    return series12(spark, sf)


@query("observed_mask", sq.series_ctes("series") + "SELECT pid, step, " + ", ".join(
    f'"{f}" IS NOT NULL AS "{f}"' for f in FEATURES) + " FROM series")
def observed_mask(spark, sf):
    return gr.observed_mask(series12(spark, sf), FEATURES)


@query("all_observed_mask", sq.series_ctes("series") + "SELECT pid, step, " + ", ".join(
    f'true AS "{f}"' for f in FEATURES) + " FROM series")
def all_observed_mask(spark, sf):
    return gr.all_observed_mask(series12(spark, sf), FEATURES)


@query("minmax_params", sq.series_ctes("params") + "SELECT * FROM params")
def minmax_params(spark, sf):
    return scaling.fit_scaler(series12(spark, sf).filter(F.col("pid") % 5 < 4), FEATURES)


@query("minmax_scale", sq.series_ctes("params") + f"""
    SELECT pid, step, feature, round({sq.scale_sql('value')}, 6) AS value FROM cells JOIN params USING (feature)""")
def minmax_scale(spark, sf):
    series = series12(spark, sf)
    params = scaling.fit_scaler(series.filter(F.col("pid") % 5 < 4), FEATURES)
    return r6(gr.to_long(scaling.scale_series(series, params, FEATURES), FEATURES), "value")


@query("minmax_roundtrip", sq.series_ctes("series") + "SELECT * FROM series")
def minmax_roundtrip(spark, sf):
    series = series12(spark, sf)
    params = scaling.fit_scaler(series.filter(F.col("pid") % 5 < 4), FEATURES)
    return scaling.unscale_series(scaling.scale_series(series, params, FEATURES), params, FEATURES)


@query("external_scale", sq.series_ctes("cells", own=f"""
    SELECT feature, min(value) AS low, max(value) AS high FROM cells WHERE NOT ({sq.TRAIN}) GROUP BY feature""") + f"""
    SELECT pid, step, feature, round({sq.scale_sql('value', 0, 1)}, 6) AS value
    FROM cells JOIN own USING (feature) WHERE NOT ({sq.TRAIN})""")
def external_scale(spark, sf):
    external = series12(spark, sf).filter(F.col("pid") % 5 >= 4)
    params = scaling.fit_scaler(external, FEATURES)
    return r6(gr.to_long(scaling.scale_series(external, params, FEATURES, 0.0, 1.0), FEATURES), "value")


@query("wide_vectors", sq.series_ctes("series") + "SELECT pid, " + ", ".join(
    f'max(CASE WHEN step = {s} THEN "{f}" END) AS "{f}_{s}"' for s in range(1, 7) for f in FEATURES
) + " FROM series GROUP BY pid")
def wide_vectors(spark, sf):
    return gr.patient_vector(series12(spark, sf), FEATURES, range(1, 7))


@query("complete_cases", sq.series_ctes("series") + f"SELECT {sq.COLUMNS} FROM series WHERE " + " AND ".join(
    f'"{f}" IS NOT NULL' for f in FEATURES))
def complete_cases(spark, sf):
    return gr.complete_cases(series12(spark, sf), FEATURES)


_VITALS = {
    "systolic_bp": '"signup"', "respiratory_rate": '"click"', "diastolic_bp": '"error"', "heart_rate": '"view"',
    "arterial_bp_mean": '("signup" + 2 * "error") / 3', "spo2": '("view" + "signup") / 2', "temperature": '"purchase"',
}


@query("display_labels", sq.series_ctes("series") + "SELECT pid, step, " + ", ".join(
    f'round({e}, 6) AS "{label}"' for e, label in zip(_VITALS.values(), (
        "Presión arterial sistólica (mmHg)", "Frecuencia respiratoria (bpm)", "Presión arterial diastólica (mmHg)",
        "Frecuencia cardiaca (bpm)", "Presión arterial media (mmHg)", "SpO2", "Temperatura (C)"))) + " FROM series")
def display_labels(spark, sf):
    vitals = series12(spark, sf).select(
        "pid", "step", *[F.round(F.expr(e.replace('"', "`")), 6).alias(n) for n, e in _VITALS.items()]
    )
    return relations.spanish_labels(vitals)


# --- windows -------------------------------------------------------------------------------

_ORDERED = "SELECT user_id AS pid, ts, event_id, value FROM events"


def _ordered(spark, sf):
    return source(spark, sf, "events").select(F.col("user_id").alias("pid"), "ts", "event_id", "value")


@query("history_target_split", f"""
    SELECT *, CASE WHEN step <= 6 THEN 'history' ELSE 'target' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) AS step FROM ({_ORDERED})) WHERE step <= 12""")
def history_target_split(spark, sf):
    return windows.split_history_target(_ordered(spark, sf), ["ts", "event_id"])


_BY_CUSTOMER = "SELECT o_custkey AS pid, o_orderdate, o_orderkey, o_totalprice FROM orders"


@query("edge_pad", f"""
    WITH r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY pid) AS c FROM ({_BY_CUSTOMER})
               WINDOW w AS (PARTITION BY pid ORDER BY o_orderdate, o_orderkey)),
    k AS (SELECT * FROM r WHERE n <= 12),
    spine AS (SELECT DISTINCT pid, least(c, 12) AS c, unnest(range(1, 13)) AS step FROM k)
    SELECT s.pid, o_orderdate, o_orderkey, o_totalprice, CAST(s.step AS INT) AS step
    FROM spine s JOIN k ON k.pid = s.pid AND k.n = greatest(1, s.step - (12 - s.c))""")
def edge_pad(spark, sf):
    rows = source(spark, sf, "orders").select(
        F.col("o_custkey").alias("pid"), "o_orderdate", "o_orderkey", "o_totalprice"
    )
    return windows.edge_pad(rows, ["o_orderdate", "o_orderkey"], 12)


@query("complete_groups", f"""
    SELECT * FROM ({_BY_CUSTOMER}) WHERE pid IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)""")
def complete_groups(spark, sf):
    rows = source(spark, sf, "orders").select(
        F.col("o_custkey").alias("pid"), "o_orderdate", "o_orderkey", "o_totalprice"
    )
    return gr.complete_groups(rows, 12)


_LAG = 'coalesce(lag("{f}", {d}) OVER (PARTITION BY pid ORDER BY step), 0)'


@query("dilated_conv", sq.series_ctes("series") + "SELECT pid, step, " + ", ".join(
    "round(" + " + ".join(f'0.5 * coalesce("{f}", 0) - 0.25 * ' + _LAG.format(f=f, d=d) for f in FEATURES) + f", 6) AS response_{d}"
    for d in (1, 2, 4)) + " FROM series")
def dilated_conv(spark, sf):
    out = series12(spark, sf)
    kernel = {f: (0.5, -0.25) for f in FEATURES}
    for d in (1, 2, 4):
        out = windows.dilated_causal_filter(out, kernel, d, f"response_{d}")
    return r6(out.drop(*FEATURES), "response_1", "response_2", "response_4")


# --- conditions and examples ---------------------------------------------------------------

_CONDITIONS = f"""
    SELECT PID AS pid, {sq.half_even_sql('AGE', 1)} AS age, CAST(GENDER = 'M' AS INT) AS gender,
           "Diabetes mellitus" AS diabetes, Hypertension AS hypertension,
           CAST("Cardiac dysrhythmias" + "Cardiac arrest and ventricular fibrillation" >= 1 AS INT) AS heart_diseases,
           CAST(ICU = 'MICU' AS INT) AS micu, CAST(ICU = 'CSRU' AS INT) AS csru, CAST(ICU = 'SICU' AS INT) AS sicu,
           CAST(ICU = 'CCU' AS INT) AS ccu, CAST(ICU = 'TSICU' AS INT) AS tsicu
    FROM demographics"""


@query("conditions_table", with_views("demographics") + _CONDITIONS)
def conditions_table(spark, sf):
    return cd.conditions(spark_view(spark, sf, "demographics"))


_USERS = "SELECT DISTINCT user_id AS pid FROM events"
_ONCE = "SELECT PID FROM demographics_repeated GROUP BY PID HAVING count(*) = 1"


@query("unique_match_guard", with_views("demographics_repeated") + f"""
    SELECT pid, pid IN ({_ONCE}) AS included FROM ({_USERS})""")
def unique_match_guard(spark, sf):
    return cd.unique_matches(spark_view(spark, sf, "demographics_repeated"), spark_view(spark, sf, "observations"))


@query("match_summary", with_views("demographics_repeated") + f"""
    SELECT count(CASE WHEN pid IN ({_ONCE}) THEN 1 END) AS patients_included,
           count(CASE WHEN pid NOT IN ({_ONCE}) THEN 1 END) AS patients_removed FROM ({_USERS})""")
def match_summary(spark, sf):
    return cd.match_summary(spark_view(spark, sf, "observations"), spark_view(spark, sf, "demographics_repeated"))


_TWICE = "SELECT * FROM demographics UNION ALL SELECT * FROM demographics WHERE PID % 3 = 0"


@query("matched_series", sq.series_ctes("series", demographics=sql_view("demographics"), twice=_TWICE) + f"""
    SELECT pid, step, {_r6_sql(FEATURES)} FROM series
    WHERE pid IN (SELECT PID FROM twice GROUP BY PID HAVING count(*) = 1)""")
def matched_series(spark, sf):
    """Series of the patients with one demographics row, when every third patient has two."""
    demo = spark_view(spark, sf, "demographics")
    _, series = cd.matched_series(series12(spark, sf), demo.unionByName(demo.filter(F.col("PID") % 3 == 0)))
    return r6(series, *FEATURES)


def examples(spark, sf):
    cells = filled_scaled(spark, sf)
    series = gr.to_wide(cells, FEATURES)
    mask = cells.groupBy("pid", "step").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("observed"))).alias(f) for f in FEATURES]
    )
    return cd.training_examples(series, mask, cd.conditions(spark_view(spark, sf, "demographics")), FEATURES)


_ORDER_F = "list_position([" + ", ".join(f"'{f}'" for f in FEATURES) + "], feature)"


@query("training_examples", sq.series_ctes("scaled", demographics=sql_view("demographics"), c=_CONDITIONS) + f"""
    SELECT s.pid, past, target, target_mask, round(c.age, 1) || '/' || c.gender || '/' || c.tsicu AS static
    FROM (SELECT pid, string_agg(CASE WHEN step <= 6 THEN coalesce(CAST(CAST(round(v * 10000) AS BIGINT) AS VARCHAR), '') END, ',' ORDER BY step, {_ORDER_F}) AS past,
                 string_agg(CASE WHEN step > 6 THEN coalesce(CAST(CAST(round(v * 10000) AS BIGINT) AS VARCHAR), '') END, ',' ORDER BY step, {_ORDER_F}) AS target,
                 string_agg(CASE WHEN step > 6 THEN CASE WHEN value IS NOT NULL THEN '1' ELSE '0' END END, ',' ORDER BY step, {_ORDER_F}) AS target_mask
          FROM scaled GROUP BY pid) s JOIN c ON c.pid = s.pid""")
def training_examples(spark, sf):
    def text(name, item):
        return F.array_join(F.transform(name, item), ",").alias(name)

    def tenth(x):
        return F.coalesce(F.round(x * 10000).cast("long").cast("string"), F.lit(""))

    return examples(spark, sf).select(
        "pid", text("past", tenth), text("target", tenth),
        text("target_mask", lambda m: F.when(m, "1").otherwise("0")),
        F.concat_ws("/", F.col("conditions")[0].cast("string"), F.col("conditions")[1].cast("int").cast("string"),
                    F.col("conditions")[5].cast("int").cast("string")).alias("static"),
    )


@query("masked_targets", sq.series_ctes("predictions") + """
    SELECT pid, step, feature, round(CASE WHEN observed THEN y END, 6) AS y, round(yhat, 6) AS yhat, observed FROM predictions""")
def masked_targets(spark, sf):
    return r6(cd.masked_targets(predictions(spark, sf)), "y", "yhat")


# --- sampling ------------------------------------------------------------------------------


def _amputated(cells: str = "cells", groups: str = "", pct: str = str(RATE), seed: str = "242", key: str = "") -> str:
    key = key or sq.cell_key_sql(seed)
    part = f"{groups}{',' if groups else ''} feature, value IS NULL"
    return f"""
    SELECT * EXCLUDE (value, rk, n), value AS truth,
           value IS NOT NULL AND rk <= round(n * {pct} / 100.0) AS masked,
           CASE WHEN NOT (value IS NOT NULL AND rk <= round(n * {pct} / 100.0)) THEN value END AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {key}, pid, step) AS rk,
                 count(*) OVER (PARTITION BY {part}) AS n FROM {cells})"""


AMPUTATED = _amputated()


def stored_cells(spark, sf):
    """The 12-step series as a stored table: amputation and imputation read it many times."""
    return gr.to_long(cut_lineage(series12(spark, sf)), FEATURES)


def amputated(spark, sf):
    return sampling.amputate(stored_cells(spark, sf), FEATURES, RATE, 242)


@query("amputate_mask", sq.series_ctes("cells", amputated=AMPUTATED) + "SELECT pid, step, feature, value, truth, masked FROM amputated")
def amputate_mask(spark, sf):
    return amputated(spark, sf).select(*CELL, "value", "truth", "masked")


_CUSTOMERS = "SELECT c_custkey AS pid FROM customer"


def _customers(spark, sf):
    return source(spark, sf, "customer").select(F.col("c_custkey").alias("pid"))


@query("sample_patients", f"""
    SELECT pid, draw FROM (SELECT pid, row_number() OVER (ORDER BY {sq.key_sql('pid', 42)}, pid) AS draw FROM ({_CUSTOMERS})) WHERE draw <= 100""")
def sample_patients(spark, sf):
    return sampling.sample_patients(_customers(spark, sf), 100)


@query("fold_assign", f"""
    SELECT repeat, pid, CAST((row_number() OVER (PARTITION BY repeat ORDER BY {sq.key_sql('pid', 'repeat')}, pid) - 1) % 5 AS INT) AS fold
    FROM (SELECT pid, unnest(range(1, 11)) AS repeat FROM ({_CUSTOMERS}))""")
def fold_assign(spark, sf):
    return sampling.assign_folds(_customers(spark, sf), 5, 10)


@query("stratified_split", f"""
    SELECT doc_id, quality, CASE WHEN rk > floor(n * 0.8 + 1e-9) THEN 'test' ELSE 'train' END AS subset
    FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {sq.key_sql('doc_id', 1)}, doc_id) AS rk,
                 count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def stratified_split(spark, sf):
    return sampling.stratified_split(source(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("first_patients", f"""
    SELECT * FROM ({_BY_CUSTOMER}) WHERE pid IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 320)""")
def first_patients(spark, sf):
    rows = source(spark, sf, "orders").select(
        F.col("o_custkey").alias("pid"), "o_orderdate", "o_orderkey", "o_totalprice"
    )
    return sampling.first_patients(rows, 320)


@query("training_batches", f"""
    SELECT pid, CAST((row_number() OVER (ORDER BY {sq.key_sql('pid', 1)}, pid) - 1) // 32 AS BIGINT) AS batch FROM ({_CUSTOMERS})""")
def training_batches(spark, sf):
    return sampling.batches(_customers(spark, sf), 32)


# --- imputation ----------------------------------------------------------------------------


def _imputed(df):
    return r6(df.select(*CELL, "imputed"), "imputed")


_IMPUTED = "SELECT pid, step, feature, round(imputed, 6) AS imputed FROM imputed"


def mean_sql(cells: str, groups: str = "") -> str:
    part = f"PARTITION BY {groups}{',' if groups else ''} feature"
    return f"SELECT *, coalesce(value, avg(value) OVER ({part})) AS imputed FROM {cells}"


def moving_sql(cells: str, groups: str = "") -> str:
    part = f"PARTITION BY {groups}{',' if groups else ''} pid, feature ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"
    return f"SELECT *, coalesce(value, avg(value) OVER ({part}), 0) AS imputed FROM {cells}"


def random_sql(cells: str, groups: str = "") -> str:
    g = [x.strip() for x in groups.split(",") if x.strip()] + ["feature"]
    part = ", ".join(g)
    match = " AND ".join(f"m.{x} = d.{x}" for x in g)
    key = sq.cell_key_sql(242)
    return f"""
    SELECT m.*, coalesce(m.value, d.value) AS imputed
    FROM (SELECT *, ({sq.key_sql(key, 243)}) % count(value) OVER (PARTITION BY {part}) + 1 AS pick FROM {cells}) m
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {key}, pid, step) AS donor FROM {cells} WHERE value IS NOT NULL) d
      ON {match} AND m.pick = d.donor"""


def em_sql(cells: str, groups: str = "") -> str:
    """Loops unrolled: every loop redraws the missing cells from the last estimate."""
    part = f"PARTITION BY {groups}{',' if groups else ''} feature"
    key = sq.cell_key_sql(242)
    body = f"SELECT *, value AS x0 FROM {cells}"
    for i in range(1, impute.EM_LOOPS + 1):
        draw = f"avg(x{i - 1}) OVER ({part}) + stddev_pop(x{i - 1}) OVER ({part}) * {sq.normal_sql(key, 101 * i)}"
        body = f"SELECT *, coalesce(value, {draw}) AS x{i} FROM ({body})"
    return f"SELECT * EXCLUDE ({', '.join(f'x{i}' for i in range(impute.EM_LOOPS + 1))}), x{impute.EM_LOOPS} AS imputed FROM ({body})"


def _register(name: str, sql_body: str, fill):
    @query(name, sq.series_ctes("cells", amputated=AMPUTATED, imputed=sql_body) + _IMPUTED)
    def run(spark, sf):
        return _imputed(fill(amputated(spark, sf)))

    return run


_register("impute_mean", mean_sql("amputated"), impute.fill_mean)
_register("impute_linear", sq.linear_sql("amputated"), impute.fill_linear)
_register("impute_moving", moving_sql("amputated"), impute.fill_moving)
_register("impute_random", random_sql("amputated"), lambda c: impute.fill_random(c, FEATURES))
_register("impute_em", em_sql("amputated"), lambda c: impute.fill_em(c, FEATURES))

_COLUMN_SQL = {
    "simple": mean_sql, "interpolate_linear": sq.linear_sql, "random": random_sql,
    "expectation_maximization": em_sql, "moving_window": moving_sql,
}
_GRID_SQL = {"interpolate_linear": lambda c, g: sq.linear_sql(c, "value", g)}
REPS, RATES = 10, (10, 20, 30, 40, 50)
_EXPERIMENT = {
    "spread": f"SELECT c.*, r.rep, p.pct FROM unit_cells c, (SELECT unnest(range(0, {REPS})) AS rep) r, (SELECT unnest([10, 20, 30, 40, 50]) AS pct) p",
    "experiment": _amputated("spread", "rep, pct", "pct", "rep * 100 + pct"),
}
_UNIT = f"""SELECT pid, step, feature, {sq.scale_sql('value', 0, 1)} AS value
    FROM cells JOIN (SELECT feature, min(value) AS low, max(value) AS high FROM cells GROUP BY feature) USING (feature)"""


def unit_cells(spark, sf):
    """Cells scaled to (0, 1), as the imputation experiment takes them."""
    cells = stored_cells(spark, sf)
    return scaling.scale_cells(cells, scaling.fit_cells(cells))


SCORES = "\nUNION ALL ".join(
    f"SELECT '{name}' AS method, rep, pct, sqrt(avg(pow(truth - imputed, 2))) AS rmse, count(*) AS cells"
    f" FROM ({_GRID_SQL.get(name, make)('experiment', 'rep, pct')}) WHERE masked GROUP BY rep, pct"
    for name, make in _COLUMN_SQL.items()
)
EXPERIMENT_CTES = {"unit_cells": _UNIT, **_EXPERIMENT}


def score_grid(spark, sf):
    log = experiment.score_log(unit_cells(spark, sf), FEATURES, experiment.column_scores(), REPS, RATES)
    return log.select("rep", "pct", "rmse", "cells", "method")


@query("impute_score_grid", sq.series_ctes("cells", **EXPERIMENT_CTES, scores=SCORES)
       + "SELECT method, CAST(rep AS INT) AS rep, pct, round(rmse, 6) AS rmse, cells FROM scores")
def impute_score_grid(spark, sf):
    return r6(score_grid(spark, sf), "rmse")


def _unit_amputated(spark, sf):
    return sampling.amputate(unit_cells(spark, sf), FEATURES, RATE, 242)


_KNN_DISTANCE = " + ".join(f'coalesce(pow(r."{f}" - d."{f}", 2), 0)' for f in FEATURES)
_KNN_SHARED = " + ".join(f'CAST(r."{f}" IS NOT NULL AND d."{f}" IS NOT NULL AS INT)' for f in FEATURES)
_KNN = {
    "unit_cells": _UNIT,
    "amputated": _amputated("unit_cells"),
    "wide": "SELECT pid, step, " + ", ".join(f"max(value) FILTER (WHERE feature = '{f}') AS \"{f}\"" for f in FEATURES)
    + " FROM amputated GROUP BY pid, step",
    "near": "\nUNION ALL ".join(
        f"""SELECT r.pid, r.step, '{f}' AS feature,
            min_by({{'d': dist, 'v': d_value}}, {{'d': dist, 'p': donor, 's': donor_step}}, 5) AS best
        FROM (SELECT r.pid, r.step, d."{f}" AS d_value, d.pid AS donor, d.step AS donor_step,
                     round(({_KNN_DISTANCE}) * {len(FEATURES)} / ({_KNN_SHARED}), 12) AS dist
              FROM wide r JOIN wide d ON d."{f}" IS NOT NULL AND r."{f}" IS NULL AND ({_KNN_SHARED}) > 0) r
        GROUP BY r.pid, r.step"""
        for f in FEATURES
    ),
    "filled_near": """
        SELECT pid, step, feature, CASE WHEN count(*) FILTER (WHERE b.d = 0) > 0 THEN avg(b.v) FILTER (WHERE b.d = 0)
               ELSE sum(b.v / sqrt(b.d)) FILTER (WHERE b.d > 0) / sum(1 / sqrt(b.d)) FILTER (WHERE b.d > 0) END AS imputed
        FROM (SELECT pid, step, feature, unnest(best) AS b FROM near) GROUP BY pid, step, feature""",
}


@query("impute_knn", sq.series_ctes("cells", **_KNN) + """
    SELECT a.pid, a.step, a.feature,
           round(coalesce(a.value, n.imputed, avg(a.value) OVER (PARTITION BY a.feature)), 6) AS imputed
    FROM amputated a LEFT JOIN filled_near n ON n.pid = a.pid AND n.step = a.step AND n.feature = a.feature""")
def impute_knn(spark, sf):
    return _imputed(knn_impute.fill_knn(_unit_amputated(spark, sf), FEATURES))


def _chained(spark, sf, fill, **options):
    wide = gr.to_wide(_unit_amputated(spark, sf), FEATURES)
    return _imputed(gr.to_long(fill(wide, FEATURES, **options), FEATURES, "imputed"))


@query("impute_iterative")
def impute_iterative(spark, sf):
    return _chained(spark, sf, regression_impute.fill_iterative)


@query("impute_mice")
def impute_mice(spark, sf):
    return _chained(spark, sf, regression_impute.fill_mice)


@query("impute_iterative_evidence")
def impute_iterative_evidence(spark, sf):
    """Iterative imputation whose ridge is chosen by the data."""
    wide = gr.to_wide(_unit_amputated(spark, sf), FEATURES)
    filled = regression_impute.fill_iterative_groups(wide, FEATURES, ridge="evidence")
    return _imputed(gr.to_long(filled.select("pid", "step", *FEATURES), FEATURES, "imputed"))


def all_methods():
    """All eight imputers on long rows of one (rep, pct), by method name."""
    def chained(fill):
        def run(cells, groups):
            filled = gr.to_long(fill(gr.to_wide(cells, FEATURES), FEATURES), FEATURES, "imputed")
            return cells.join(filled, ["pid", "step", "feature"])

        return run

    return {
        **impute.column_methods(FEATURES), "knn": lambda cells, groups: knn_impute.fill_knn(cells, FEATURES),
        "iterative": chained(regression_impute.fill_iterative), "mice": chained(regression_impute.fill_mice),
    }


def grouped_methods():
    """All eight imputers on long rows of the whole experiment, by method name; groups are (rep, pct)."""
    def chained(fill):
        def run(cells, groups):
            keys = [*groups, "pid", "step"]
            wide = gr.to_wide(cells, FEATURES, keys=keys)
            filled = gr.to_long(fill(wide, FEATURES, groups).select(*keys, *FEATURES), FEATURES, "imputed", keys)
            return cells.join(filled, [*keys, "feature"])

        return run

    return {
        **impute.column_methods(FEATURES), "knn": lambda cells, groups: knn_impute.fill_knn(cells, FEATURES, groups=groups),
        "iterative": chained(regression_impute.fill_iterative_groups), "mice": chained(regression_impute.fill_mice_groups),
    }


#: Where a session has stored the log of a data folder: its readers share one run.
_LOGS: dict[tuple[str, str], str] = {}


def experiment_log(spark, sf):
    """The log of the whole experiment, run once per session and folder and kept below the shared folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _LOGS:
        path = scratch_path(spark, "experiment-log")
        experiment.score_log(unit_cells(spark, sf), FEATURES, experiment.all_scores(), REPS, RATES).coalesce(1).write.parquet(path)
        _LOGS[at] = path
    return spark.read.parquet(_LOGS[at])


@query("impute_experiment_log")
def impute_experiment_log(spark, sf):
    return r6(experiment_log(spark, sf), "rmse")

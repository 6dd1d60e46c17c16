"""Forecast scores, distances between series, classification scores, models, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardframe.operators import alignment as al
from wardframe.operators import boosting, classify, metrics, models, reports, sampling
from wardframe.operators import cohort as co
from wardframe.operators import conditions as cd
from wardframe.operators import grid as gr
from wardframe.plans import series_sql as sq
from wardframe.plans.inputs import source, spark_view
from wardframe.plans.registry import query
from wardframe.plans.series import (
    EXPERIMENT_CTES,
    FEATURES,
    SCORES,
    examples,
    experiment_log,
    filled_scaled,
    predictions,
    r6,
    score_grid,
    stored_cells,
)
from wardframe.session import cut_lineage, scratch_path

GAMMA, N = 0.01, 6
_ERR = "(y - yhat)"


def _pred(body: str, **ctes: str) -> str:
    return sq.series_ctes("predictions", **ctes) + body


# --- errors --------------------------------------------------------------------------------


@query("masked_metrics", _pred(f"""
    SELECT feature, count(*) AS cells, round(avg({_ERR} ** 2), 6) AS mse, round(sqrt(avg({_ERR} ** 2)), 6) AS rmse,
           round(avg(abs({_ERR})), 6) AS mae, round(1 - sum({_ERR} ** 2) / (var_pop(y) * count(*)), 6) AS r2
    FROM predictions WHERE observed AND yhat IS NOT NULL GROUP BY feature"""))
def masked_metrics(spark, sf):
    return r6(metrics.masked_scores(predictions(spark, sf), ["feature"]), "mse", "rmse", "mae", "r2")


@query("dimwise_mean", _pred("""
    SELECT step, feature, round(avg(y), 6) AS real, round(avg(yhat), 6) AS predicted FROM predictions GROUP BY step, feature"""))
def dimwise_mean(spark, sf):
    return r6(metrics.dimension_means(predictions(spark, sf)), "real", "predicted")


@query("per_feature_rmse", _pred(f"""
    SELECT feature, count(rmse) AS patients, round(avg(rmse), 4) AS mean, round(stddev_pop(rmse), 4) AS std
    FROM (SELECT pid, feature, sqrt(avg({_ERR} ** 2)) AS rmse FROM predictions GROUP BY pid, feature) GROUP BY feature"""))
def per_feature_rmse(spark, sf):
    return metrics.rmse_per_feature(predictions(spark, sf), 4)


_BATCHES = f"""SELECT pid, CAST((row_number() OVER (ORDER BY {sq.key_sql('pid', 1)}, pid) - 1) // 32 AS BIGINT) AS batch
    FROM (SELECT DISTINCT user_id AS pid FROM events)"""


def _batches(spark, sf):
    return sampling.batches(source(spark, sf, "events").select(F.col("user_id").alias("pid")), 32)


@query("batch_report", _pred(f"""
    SELECT metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std
    FROM (UNPIVOT (SELECT batch, sqrt(avg({_ERR} ** 2)) AS rmse, avg(abs({_ERR})) AS mae,
                          1 - sum({_ERR} ** 2) / (var_pop(y) * count(*)) AS r2
                   FROM predictions JOIN batches USING (pid) WHERE observed AND yhat IS NOT NULL GROUP BY batch)
          ON rmse, mae, r2 INTO NAME metric VALUE score) GROUP BY metric""", batches=_BATCHES))
def batch_report(spark, sf):
    return metrics.batch_report(predictions(spark, sf), _batches(spark, sf), 6)


@query("prediction_interval", _pred(f"""
    SELECT pid, step, feature, round(yhat - w, 6) AS lower, round(yhat + w, 6) AS upper
    FROM predictions JOIN (SELECT feature, 1.96::DOUBLE * sqrt(sum({_ERR} ** 2) / (count({_ERR}) - 2)) AS w FROM predictions GROUP BY feature)
    USING (feature)"""))
def prediction_interval(spark, sf):
    out = metrics.prediction_interval(predictions(spark, sf)).select("pid", "step", "feature", "lower", "upper")
    return r6(out, "lower", "upper")


@query("bootstrap_ci", _pred(f"""
    SELECT feature, round(avg(mse), 6) AS mean, round(stddev_samp(mse), 6) AS std,
           round(quantile_cont(mse, 0.05), 6) AS q05, round(quantile_cont(mse, 0.95), 6) AS q95
    FROM (SELECT d.feature, d.replicate, avg((n.y - n.yhat) ** 2) AS mse FROM draws d
          JOIN numbered n ON n.feature = d.feature AND n.rk = d.pick GROUP BY d.feature, d.replicate)
    GROUP BY feature""", numbered=f"""
    SELECT *, row_number() OVER (PARTITION BY feature ORDER BY {sq.cell_key_sql(7)}, pid, step) AS rk,
           count(*) OVER (PARTITION BY feature) AS n FROM predictions WHERE yhat IS NOT NULL""", draws=f"""
    SELECT feature, replicate, ({sq.key_sql('rk', 'replicate * 31 + 123')}) % n + 1 AS pick
    FROM numbered, (SELECT unnest(range(1, 11)) AS replicate)"""))
def bootstrap_ci(spark, sf):
    return r6(metrics.bootstrap_mse(predictions(spark, sf), FEATURES), "mean", "std", "q05", "q95")


@query("real_vs_predicted", _pred("""
    SELECT pid, step, feature, kind, round(v, 6) AS value FROM (
      SELECT pid, step, feature, 'real' AS kind, y AS v FROM predictions UNION ALL
      SELECT pid, step, feature, 'predicted', yhat FROM predictions)"""))
def real_vs_predicted(spark, sf):
    return r6(metrics.real_and_predicted(predictions(spark, sf)), "value")


def _box_sql(keys: str, value: str, rows: str) -> str:
    quartiles = ", ".join(
        f"round(quantile_cont({value}, {q}), 6) AS {n}" for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    )
    return f"""SELECT {keys}, CAST(count({value}) AS BIGINT) AS n, round(min({value}), 6) AS low, {quartiles},
        round(max({value}), 6) AS high FROM ({rows}) GROUP BY {keys}"""


_BOX = ("low", "q1", "median", "q3", "high")


@query("feature_box_stats", _pred(_box_sql("feature, kind", "value", """
    SELECT feature, 'real' AS kind, y AS value FROM predictions UNION ALL SELECT feature, 'predicted', yhat FROM predictions""")))
def feature_box_stats(spark, sf):
    rows = metrics.real_and_predicted(predictions(spark, sf))
    return r6(reports.box_statistics(rows, ["feature", "kind"], "value"), *_BOX)


def _whisker_sql(keys: str, value: str, rows: str) -> str:
    on = " AND ".join(f"r.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    inside = f"r.{value} BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)"
    return f"""SELECT {named}, b.n, round(b.low, 6) AS low, round(b.q1, 6) AS q1, round(b.median, 6) AS median, round(b.q3, 6) AS q3, round(b.high, 6) AS high,
        round(min(r.{value}) FILTER ({inside}), 6) AS whisker_low, round(max(r.{value}) FILTER ({inside}), 6) AS whisker_high,
        count(*) FILTER (NOT ({inside})) AS beyond
        FROM ({rows}) r JOIN (SELECT {keys}, CAST(count({value}) AS BIGINT) AS n, min({value}) AS low, quantile_cont({value}, 0.25) AS q1,
          quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3, max({value}) AS high FROM ({rows}) GROUP BY {keys}) b ON {on}
        WHERE r.{value} IS NOT NULL GROUP BY {named}, b.n, b.low, b.q1, b.median, b.q3, b.high"""


_WHISKERS = (*_BOX, "whisker_low", "whisker_high")


@query("feature_box_whiskers", _pred(_whisker_sql("feature, kind", "value", """
    SELECT feature, 'real' AS kind, y AS value FROM predictions UNION ALL SELECT feature, 'predicted', yhat FROM predictions""")))
def feature_box_whiskers(spark, sf):
    rows = cut_lineage(metrics.real_and_predicted(predictions(spark, sf)))
    return r6(reports.box_whiskers(rows, ["feature", "kind"], "value"), *_WHISKERS)


_LOSSES = f"SELECT pid, step, feature, 'mse' AS loss, {_ERR} ** 2 AS value FROM predictions UNION ALL SELECT pid, step, feature, 'mae', abs({_ERR}) FROM predictions"


def _losses(spark, sf):
    e = F.col("y") - F.col("yhat")
    rows = predictions(spark, sf).select("pid", "step", "feature", (e * e).alias("mse"), F.abs(e).alias("mae"))
    return rows.unpivot(["pid", "step", "feature"], ["mse", "mae"], "loss", "value")


@query("loss_box_stats", _pred(_box_sql("loss", "value", _LOSSES)))
def loss_box_stats(spark, sf):
    return r6(reports.box_statistics(_losses(spark, sf), ["loss"], "value"), *_BOX)


@query("loss_box_whiskers", _pred(_whisker_sql("loss", "value", _LOSSES)))
def loss_box_whiskers(spark, sf):
    return r6(reports.box_whiskers(cut_lineage(_losses(spark, sf)), ["loss"], "value"), *_WHISKERS)


@query("runs_side_by_side", _pred(f"""
    SELECT pid || ':' || step AS position, round(max(CASE WHEN loss = 'mse' THEN value END), 6) AS mse,
           round(max(CASE WHEN loss = 'mae' THEN value END), 6) AS mae FROM ({_LOSSES}) GROUP BY 1"""))
def runs_side_by_side(spark, sf):
    rows = _losses(spark, sf).withColumn("position", F.concat_ws(":", F.col("pid").cast("string"), F.col("step").cast("string")))
    return r6(reports.runs_side_by_side(rows, ["mse", "mae"]), "mse", "mae")


# --- distribution distances ----------------------------------------------------------------

_KERNEL = " + ".join(f"exp(-0.5 * ({{d}}) / {a})" for a in metrics.MMD_BANDWIDTHS)


@query("mmd_scalar", _pred("""
    SELECT a.feature, round(avg({yy} + {pp}) - 2 * avg({yp}), 6) AS mmd
    FROM predictions a JOIN predictions b ON a.feature = b.feature WHERE a.yhat IS NOT NULL AND b.yhat IS NOT NULL GROUP BY a.feature""".format(
    yy=_KERNEL.format(d="(a.y - b.y) ** 2"), pp=_KERNEL.format(d="(a.yhat - b.yhat) ** 2"), yp=_KERNEL.format(d="(a.y - b.yhat) ** 2"))))
def mmd_scalar(spark, sf):
    return r6(metrics.scalar_mmd(predictions(spark, sf), ["feature"]), "mmd")


@query("mmd_unscaled", sq.series_ctes("cells", pairs="""
    SELECT t.feature, 10 * t.value AS y, 10 * h.value AS p FROM cells t JOIN cells h ON h.pid = t.pid AND h.feature = t.feature AND h.step = t.step - 6
    WHERE t.value IS NOT NULL AND h.value IS NOT NULL""") + """
    SELECT a.feature, round(avg({yy} + {pp}) - 2 * avg({yp}), 6) AS mmd FROM pairs a JOIN pairs b ON a.feature = b.feature GROUP BY a.feature""".format(
    yy=_KERNEL.format(d="(a.y - b.y) ** 2"), pp=_KERNEL.format(d="(a.p - b.p) ** 2"), yp=_KERNEL.format(d="(a.y - b.p) ** 2")))
def mmd_unscaled(spark, sf):
    """Values as they were charted (times ten), against those six steps before."""
    cells = stored_cells(spark, sf).where("value IS NOT NULL")
    before = cells.select("pid", "feature", (F.col("step") + 6).alias("step"), (10 * F.col("value")).alias("yhat"))
    pairs = cells.withColumn("y", 10 * F.col("value")).join(before, ["pid", "feature", "step"])
    return r6(metrics.gauss_mmd(pairs, ["feature"]), "mmd")


@query("mmd_batches", sq.series_ctes("scaled", batches=_BATCHES, long="""
    SELECT batch, t.pid, t.step, t.feature, coalesce(t.v, 0) AS y, coalesce(h.v, 0) AS p FROM scaled t
    JOIN scaled h ON h.pid = t.pid AND h.feature = t.feature AND h.step = t.step - 6 JOIN batches b ON b.pid = t.pid WHERE t.step > 6""",
    pairs="""SELECT a.batch, a.pid AS i, b.pid AS j, sum((a.y - b.y) ** 2) AS yy, sum((a.p - b.p) ** 2) AS pp, sum((a.p - b.y) ** 2) AS py
    FROM long a JOIN long b ON a.batch = b.batch AND a.step = b.step AND a.feature = b.feature GROUP BY 1, 2, 3""") + """
    SELECT batch, count(DISTINCT i) AS patients, round(avg({yy} + {pp} - 2 * ({py})), 6) AS mmd FROM pairs GROUP BY batch""".format(
    yy=_KERNEL.format(d="yy"), pp=_KERNEL.format(d="pp"), py=_KERNEL.format(d="py")))
def mmd_batches(spark, sf):
    def known(name):
        return F.transform(name, lambda x: F.coalesce(x, F.lit(0.0)))

    vectors = examples(spark, sf).select("pid", known("target").alias("real"), known("past").alias("predicted"))
    return r6(metrics.vector_mmd(vectors.join(_batches(spark, sf), "pid").drop("pid")), "mmd")


@query("kl_gauss", """
    SELECT label, round(-0.5 * sum(1 + s - m * m - exp(s)), 4) AS kl, round(sum((m - r) ** 2), 4) AS sse,
           round(-0.5 * sum(1 + s - m * m - exp(s)) + sum((m - r) ** 2), 4) AS loss
    FROM (SELECT label, embedding[k]::DOUBLE AS m, embedding[k + 1]::DOUBLE AS s, embedding[k + 2]::DOUBLE AS r
          FROM embeddings, (SELECT unnest(range(1, 63)) AS k)) GROUP BY label""")
def kl_gauss(spark, sf):
    e = F.col("embedding")
    rows = source(spark, sf, "embeddings").select("label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(61))).alias("k"))
    rows = rows.select(
        "label", e[F.col("k")].cast("double").alias("mu"), e[F.col("k") + 1].cast("double").alias("logvar"),
        e[F.col("k")].cast("double").alias("y"), e[F.col("k") + 2].cast("double").alias("yhat"),
    )
    return metrics.gaussian_kl(rows, ["label"]).select("label", *[F.round(c, 4).alias(c) for c in ("kl", "sse", "loss")])


_P = "1 / (1 + exp(-(n_chars - 2000) / 2000.0::DOUBLE))"


@query("dice_bce", f"""
    SELECT lang, round(b, 6) AS bce, round(d, 6) AS dice, round(b + d, 6) AS loss FROM (
      SELECT lang, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS b, 1 - (2 * sum(y * p) + 1) / (sum(y) + sum(p) + 1) AS d
      FROM (SELECT lang, quality::DOUBLE AS y, {_P} AS p FROM labels JOIN documents USING (doc_id)) GROUP BY lang)""")
def dice_bce(spark, sf):
    rows = source(spark, sf, "labels").join(source(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = rows.select(
        "lang", F.col("quality").cast("double").alias("y"), (1 / (1 + F.exp(-(F.col("n_chars") - 2000) / 2000.0))).alias("yhat")
    )
    return r6(metrics.dice_bce(rows, ["lang"]), "bce", "dice", "loss")


# --- alignment -----------------------------------------------------------------------------

_PAIRS = f"""SELECT pid, feature, list(y ORDER BY step) AS y, list(yhat ORDER BY step) AS p FROM predictions
    WHERE yhat IS NOT NULL GROUP BY pid, feature HAVING count(*) = {N}"""


def _pairs(spark, sf):
    rows = predictions(spark, sf).withColumn("observed", F.lit(True))
    return al.series_pairs(rows, ["pid", "feature"], ["step"])


def _alignment_sql() -> str:
    """The recursion written out cell by cell for series of six steps."""
    def v(i: int, j: int) -> str:
        return f"v{i}_{j}" if i and j else ("0" if i == j else "1e10")

    def layer(inner: str, columns: list[str]) -> str:
        return f"SELECT *, {', '.join(columns)} FROM ({inner})"

    def diagonal(d: int) -> list[tuple[int, int]]:
        return [(i, d - i) for i in range(max(1, d - N), min(N, d - 1) + 1)]

    body = "SELECT * FROM pairs"
    for d in range(2, 2 * N + 1):
        cells = [(i, j, (v(i, j - 1), v(i - 1, j - 1), v(i - 1, j))) for i, j in diagonal(d)]
        body = layer(body, [f"least({a}, {b}, {c}) AS m{i}_{j}" for i, j, (a, b, c) in cells])
        body = layer(body, [
            f"exp((m{i}_{j} - {x}) / {GAMMA}::DOUBLE) AS w{i}_{j}_{s}" for i, j, opts in cells for s, x in enumerate(opts)
        ])
        body = layer(body, [f"w{i}_{j}_0 + w{i}_{j}_1 + w{i}_{j}_2 AS z{i}_{j}" for i, j, _ in cells])
        body = layer(body, [
            f"(y[{i}] - p[{j}]) ** 2 + m{i}_{j} - {GAMMA}::DOUBLE * ln(z{i}_{j}) AS v{i}_{j}" for i, j, _ in cells
        ])

    def share(i: int, j: int, s: int) -> str:
        return f"w{i}_{j}_{s} / z{i}_{j}" if i <= N and j <= N else "0"

    def e(i: int, j: int) -> str:
        return f"e{i}_{j}" if i <= N and j <= N else "0"

    body = layer(body, [f"1.0::DOUBLE AS e{N}_{N}"])
    for d in range(2 * N - 1, 1, -1):
        body = layer(body, [
            f"{share(i, j + 1, 0)} * {e(i, j + 1)} + {share(i + 1, j + 1, 1)} * {e(i + 1, j + 1)}"
            f" + {share(i + 1, j, 2)} * {e(i + 1, j)} AS e{i}_{j}"
            for i, j in diagonal(d)
        ])
    return f"SELECT *, v{N}_{N} AS shape FROM ({body})"


_TEMPORAL = "(" + " + ".join(
    f"{(i - j) ** 2} * e{i}_{j}" for i in range(1, N + 1) for j in range(1, N + 1) if i != j
) + f") / {N * N}"


@query("distance_matrix", _pred("""
    SELECT pid, feature, i, j, round((y[i] - p[j]) ** 2, 6) AS distance
    FROM (SELECT *, unnest(range(1, 7)) AS j FROM (SELECT *, unnest(range(1, 7)) AS i FROM pairs))""", pairs=_PAIRS))
def distance_matrix(spark, sf):
    return r6(al.squared_distances(_pairs(spark, sf), ["pid", "feature"]), "distance")


@query("soft_dtw", _pred("SELECT pid, feature, round(shape, 6) AS shape FROM aligned", pairs=_PAIRS, aligned=_alignment_sql()))
def soft_dtw(spark, sf):
    rows = _pairs(spark, sf)
    return rows.select("pid", "feature", F.round(al.soft_dtw(F.col("real"), F.col("predicted"), GAMMA), 6).alias("shape"))


@query("dilate", _pred(f"""
    SELECT pid, feature, round(shape, 6) AS shape, round(t, 6) AS temporal, round(0.3::DOUBLE * shape + 0.7::DOUBLE * t, 6) AS dilate
    FROM (SELECT *, {_TEMPORAL} AS t FROM aligned)""", pairs=_PAIRS, aligned=_alignment_sql()))
def dilate(spark, sf):
    scored = al.dilate(_pairs(spark, sf), 0.3, GAMMA).select("pid", "feature", "shape", "temporal", "dilate")
    return r6(scored, "shape", "temporal", "dilate")


@query("alignment_path", _pred("SELECT pid, feature, x.i AS i, x.j AS j, round(x.e, 6) AS e FROM (SELECT pid, feature, unnest([" + ", ".join(
    f"{{'i': {i}, 'j': {j}, 'e': e{i}_{j}}}" for i in range(1, N + 1) for j in range(1, N + 1)) + "]) AS x FROM aligned)",
    pairs=_PAIRS, aligned=_alignment_sql()))
def alignment_path(spark, sf):
    return r6(al.path_rows(_pairs(spark, sf), ["pid", "feature"], GAMMA), "e")


@query("dilate_masked")
def dilate_masked(spark, sf):
    """One flattened series per patient, masked cells dropped within the patient."""
    pairs = al.series_pairs(predictions(spark, sf), ["pid"], ["step", "feature"])
    scored = al.dilate(pairs).select("pid", F.size("real").alias("cells"), "shape", "temporal", "dilate")
    return r6(scored, "shape", "temporal", "dilate")


# --- classification ------------------------------------------------------------------------

_SCORED = "SELECT lang, toxic AS label, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)"


def _scored(spark, sf):
    docs = source(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return source(spark, sf, "labels").join(docs, "doc_id").select(
        "lang", F.col("toxic").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score")
    )


_POINTS = """
    SELECT lang, score AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
           sum(pos) OVER (PARTITION BY lang) AS positives, sum(neg) OVER (PARTITION BY lang) AS negatives
    FROM (SELECT lang, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
          FROM scored GROUP BY lang, score) WINDOW w AS (PARTITION BY lang ORDER BY score DESC)"""


@query("roc_points", f"""WITH scored AS ({_SCORED}), points AS ({_POINTS})
    SELECT lang, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / positives, 6) AS tpr,
           round(fp / negatives, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM points""")
def roc_points(spark, sf):
    points = classify.curve_points(_scored(spark, sf), ["lang"])
    return r6(points.drop("pos", "neg", "positives", "negatives"), "tpr", "fpr", "precision")


@query("roc_auc", f"""WITH scored AS ({_SCORED}), points AS ({_POINTS}),
    pairs AS (SELECT a.lang, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
              FROM scored a JOIN scored b ON a.lang = b.lang AND a.label = 1 AND b.label = 0 GROUP BY a.lang)
    SELECT p.lang, round(any_value(pairs.auc), 6) AS auc, round(sum(pos * (tp / (tp + fp))) / max(positives), 6) AS average_precision
    FROM points p LEFT JOIN pairs USING (lang) GROUP BY p.lang""")
def roc_auc(spark, sf):
    return r6(classify.curve_areas(classify.curve_points(_scored(spark, sf), ["lang"]), ["lang"]), "auc", "average_precision")


_CONFUSION = """SELECT lang, count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score > 0.5) AS fp,
    count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND score <= 0.5) AS tn FROM scored GROUP BY lang"""


@query("f1_weighted", f"""WITH scored AS ({_SCORED}), c AS ({_CONFUSION})
    SELECT lang, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
           round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) * (tn + fp))
                 / (tp + fp + fn + tn), 6) AS f1_weighted FROM c""")
def f1_weighted(spark, sf):
    hard = _scored(spark, sf).withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    return r6(classify.threshold_scores(hard, ["lang"]), "accuracy", "f1_weighted")


@query("class_ratio", """
    SELECT n AS negatives, p AS positives, round(n / p, 3) AS ratio, round((n + p) / (2 * n), 6) AS weight_negative,
           round((n + p) / (2 * p), 6) AS weight_positive
    FROM (SELECT count(*) FILTER (WHERE toxic = 0) AS n, count(*) FILTER (WHERE toxic = 1) AS p FROM labels)""")
def class_ratio(spark, sf):
    out = classify.class_ratio(source(spark, sf, "labels"), "toxic")
    return r6(out, "weight_negative", "weight_positive")


# --- models --------------------------------------------------------------------------------


def _split_examples(spark, sf):
    """Complete patients' examples, stored once: every model reads them several times."""
    rows = cut_lineage(examples(spark, sf))
    return rows.filter(F.col("pid") % 5 < 4), rows.filter(F.col("pid") % 5 >= 4)


@query("forecast_score")
def forecast_score(spark, sf):
    train, test = (models.forecast_rows(x, FEATURES) for x in _split_examples(spark, sf))
    model = models.fit_forecaster(train, FEATURES)
    return metrics.masked_scores(models.forecast(model, test, FEATURES), ["feature"])


@query("kfold_ensemble")
def kfold_ensemble(spark, sf):
    train, test = (models.forecast_rows(x, FEATURES) for x in _split_examples(spark, sf))
    return models.fold_ensemble(train, test, FEATURES)


_VECTOR = [f"{f}_{s}" for s in range(7, 13) for f in FEATURES]


def _outcome_tables(spark, sf):
    """Real and predicted target halves as wide vectors with the outcome label."""
    cells = cut_lineage(filled_scaled(spark, sf))
    wide = gr.to_wide(cells, FEATURES).na.fill(0.0)
    synthetic = wide.filter(F.col("step") <= 6).withColumn("step", F.col("step") + 6)
    demo = spark_view(spark, sf, "demographics")
    return tuple(
        cd.labelled(gr.patient_vector(x, FEATURES, range(7, 13)), demo)
        for x in (wide.filter(F.col("step") > 6), synthetic)
    )


@query("mortality_protocols")
def mortality_protocols(spark, sf):
    return models.protocol_matrix(*_outcome_tables(spark, sf), _VECTOR)


@query("mortality_newton")
def mortality_newton(spark, sf):
    """The protocol matrix by 100 rounds of Newton-boosted trees of depth 6."""
    return models.newton_protocols(*_outcome_tables(spark, sf), _VECTOR)


@query("protocol_by_cohort")
def protocol_by_cohort(spark, sf):
    """Accuracy by protocol and cohort, from models fitted and tested within each cohort."""
    diagnoses = spark_view(spark, sf, "diagnoses_icd")
    cohorts = co.stemi_cohort(diagnoses).select(F.col("subject_id").alias("pid"), F.lit("stemi").alias("cohort")).unionByName(
        co.nstemi_cohort(diagnoses).select(F.col("subject_id").alias("pid"), F.lit("nstemi").alias("cohort"))
    ).distinct()
    tables = [x.join(cohorts, "pid") for x in _outcome_tables(spark, sf)]
    scores = models.newton_protocols(*tables, _VECTOR, ["cohort"])
    return r6(reports.protocol_table(scores, ["stemi", "nstemi"]), "stemi", "nstemi")


@query("saved_booster_scores")
def saved_booster_scores(spark, sf):
    """A booster that is fitted, saved, loaded and then scores the held-out patients."""
    split = cut_lineage(sampling.stratified_split(_outcome_tables(spark, sf)[0], "pid", "label"))
    train = split.filter(F.col("subset") == "train").withColumn("model", F.lit("real"))
    path = scratch_path(spark, "booster")
    boosting.save_booster(spark, boosting.fit_boosters(train, _VECTOR, rounds=20, rate=0.3)["real"], path)
    held_out = split.filter(F.col("subset") == "test").select("pid", "label", *_VECTOR)
    return boosting.score(boosting.load_booster(spark, path), held_out).select("pid", "label", "score")


@query("perm_importance")
def perm_importance(spark, sf):
    """Fitted on the training part of the patients, measured on the held-out part."""
    split = cut_lineage(sampling.stratified_split(_outcome_tables(spark, sf)[0], "pid", "label"))
    model = models.fit_mortality(split.filter(F.col("subset") == "train").drop("subset"), _VECTOR)
    groups = {f: [c for c in _VECTOR if c.rsplit("_", 1)[0] == f] for f in FEATURES}
    return models.permutation_importance(model, split.filter(F.col("subset") == "test"), _VECTOR, groups)


# --- reports -------------------------------------------------------------------------------


def _band(keys: str, v: str) -> str:
    half = f"1.96::DOUBLE * stddev_samp({v}) / sqrt(count({v}))"
    return f"""{keys}, count({v}) AS n, round(avg({v}), 6) AS mean, round(avg({v}) - {half}, 6) AS band_low,
        round(avg({v}) + {half}, 6) AS band_high"""


@query("method_rate_band", sq.series_ctes("cells", **EXPERIMENT_CTES, scores=SCORES)
       + f"SELECT {_band('method, pct', 'rmse')} FROM scores GROUP BY method, pct")
def method_rate_band(spark, sf):
    return r6(reports.rmse_by_rate(score_grid(spark, sf)), "mean", "band_low", "band_high")


@query("method_rate_bootstrap_band")
def method_rate_bootstrap_band(spark, sf):
    """The band a line plot draws: percentiles of 1000 bootstrap means over the repetitions."""
    scores = score_grid(spark, sf).withColumn("rep", F.col("rep").cast("int"))
    return r6(reports.bootstrap_band(cut_lineage(scores), ["method", "pct"], "rmse", ["rep"]), "mean", "band_low", "band_high")


@query("method_time_band", f"""
    SELECT {_band('metodo, porcentaje', '(tiempo / 60)')}
    FROM (SELECT event_type AS metodo, CAST(event_id % 5 * 10 + 10 AS INT) AS porcentaje, value AS tiempo FROM events) GROUP BY metodo, porcentaje""")
def method_time_band(spark, sf):
    log = source(spark, sf, "events").select(
        F.col("event_type").alias("metodo"), (F.col("event_id") % 5 * 10 + 10).cast("int").alias("porcentaje"), F.col("value").alias("tiempo")
    )
    return r6(reports.minutes_by_rate(log), "mean", "band_low", "band_high")


@query("experiment_time_band")
def experiment_time_band(spark, sf):
    """Minutes by method and rate, from the seconds of the experiment's own log."""
    log = experiment_log(spark, sf).select(F.col("method").alias("metodo"), F.col("pct").alias("porcentaje"), F.col("seconds").alias("tiempo"))
    return r6(reports.minutes_by_rate(log), "mean", "band_low", "band_high")


_PROTOCOLS = ("TRTR", "TSTR", "TRTS")


@query("protocol_pivot", f"""
    WITH scored AS (SELECT ['TRTR', 'TSTR', 'TRTS'][CAST(doc_id % 3 + 1 AS INT)] AS protocol, CASE WHEN lang = 'en' THEN 'stemi' ELSE 'nstemi' END AS cohort,
                           toxic = CAST((n_chars % 1000) / 1000.0 > 0.5 AS INT) AS hit FROM labels JOIN documents USING (doc_id))
    SELECT protocol, round(avg(hit::INT) FILTER (WHERE cohort = 'stemi'), 6) AS stemi, round(avg(hit::INT) FILTER (WHERE cohort = 'nstemi'), 6) AS nstemi
    FROM scored GROUP BY protocol""")
def protocol_pivot(spark, sf):
    docs = source(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = source(spark, sf, "labels").join(docs, "doc_id").select(
        F.element_at(F.array(*[F.lit(p) for p in _PROTOCOLS]), (F.col("doc_id") % 3 + 1).cast("int")).alias("protocol"),
        F.when(F.col("lang") == "en", "stemi").otherwise("nstemi").alias("cohort"), F.col("toxic").alias("label"),
        ((F.col("n_chars") % 1000) / 1000.0 > 0.5).cast("int").alias("predicted"),
    )
    scores = classify.threshold_scores(rows, ["protocol", "cohort"])
    return r6(reports.protocol_table(scores, ["stemi", "nstemi"]), "stemi", "nstemi")

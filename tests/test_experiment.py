"""The imputation experiment in one plan per method: grouped regression, evidence, neighbours, selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardframe.functions.ranks import among_first, exact_rank, hash_key
from wardframe.operators import impute, knn_impute, regression_impute, sampling
from wardframe.operators import grid as gr
from wardframe.plans import series

NAMES = ("a", "b", "c", "d")


def table_of(seed, n=60, missing=0.25):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 4)) * 0.4 + 0.3 + rng.normal(size=(n, 4)) * 0.05
    x[rng.random((n, 4)) < missing] = np.nan
    return x


def frame(spark, tables):
    rows = [(g, i, *[None if np.isnan(v) else float(v) for v in row]) for g, x in tables.items() for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "g int, pid long, " + ", ".join(f"{f} double" for f in NAMES))


def plain_chain(x, rounds, ridge, bounds):
    """Row by row in numpy: the definition of the grouped form."""
    gone = np.isnan(x)
    seen = [t for t in range(x.shape[1]) if not gone[:, t].all()]
    now = np.where(gone, np.array([np.nanmean(x[:, t]) if t in seen else 0.0 for t in range(x.shape[1])]), x)
    clip = (lambda v: np.clip(v, *bounds)) if bounds else (lambda v: v)
    now = np.where(gone, clip(now), x)
    for _ in range(rounds):
        before = now.copy()
        for t in sorted((t for t in seen if gone[:, t].any()), key=lambda t: (gone[:, t].sum(), t)):
            others = [j for j in range(x.shape[1]) if j != t]
            rows = ~gone[:, t]
            design = np.column_stack([np.ones(len(x)), now[:, others]])
            gram = design[rows].T @ design[rows] + ridge * np.diag([0.0] + [1.0] * len(others))
            beta = np.linalg.lstsq(gram, design[rows].T @ x[rows, t], rcond=None)[0]
            now[~rows, t] = (design @ beta)[~rows]
        now = np.where(gone, clip(now), x)
        moved = 0.0
        for pattern in {tuple(p) for p in gone}:
            same = (gone == pattern).all(axis=1)
            moved = max(moved, np.sqrt(((now - before)[same] ** 2).mean(axis=0)).max())
        if bounds is None and moved < 1e-3:
            break
    return now


@pytest.mark.parametrize(("ridge", "bounds"), [(0.0, None), (1.0, None), (1.0, (-0.2, 0.5))])
def test_grouped_regression_equals_rows(spark, ridge, bounds):
    tables = {1: table_of(1), 2: table_of(2, 40, 0.4), 3: np.array([[np.nan] * 4, [0.1, 0.2, np.nan, np.nan], [0.3, 0.1, 0.2, np.nan]] * 4)}
    rounds = 3 if bounds else 10
    got = regression_impute.grouped_regression(frame(spark, tables), NAMES, ("g",), rounds, ridge, bounds, 0.0 if bounds else 1e-3)
    found = {(r.g, r.pid): [r[f] for f in NAMES] for r in got.collect()}
    assert len(found) == sum(map(len, tables.values()))
    for g, x in tables.items():
        want = plain_chain(x, rounds, ridge, bounds)
        assert np.allclose(np.array([found[g, i] for i in range(len(x))]), want, atol=1e-8)


def test_grouped_regression_without_groups_rows_or_gaps(spark):
    x = table_of(5, 30, 0.0)
    full = frame(spark, {1: x})
    got = regression_impute.fill_mice_groups(full, NAMES).collect()
    assert np.allclose(sorted(r.a for r in got), sorted(x[:, 0]))
    assert regression_impute.fill_iterative_groups(full.limit(0), NAMES).count() == 0
    assert regression_impute.fill_mice_groups(full.limit(0), NAMES, ("g",)).count() == 0


def test_evidence_finds_the_best_ridge():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) * [1.0, 2.0, 0.5] + 4
    y = x @ [0.5, 0.0, 1.0] + rng.normal(size=80) * 0.7 - 2
    design = np.column_stack([np.ones(80), x, y])
    beta = regression_impute.evidence_solve(design.T @ design)
    xc, yc = x - x.mean(axis=0), y - y.mean()

    def log_evidence(prior, noise):
        a = prior * np.eye(3) + noise * xc.T @ xc
        m = noise * np.linalg.solve(a, xc.T @ yc)
        error = noise * ((yc - xc @ m) ** 2).sum() + prior * m @ m
        return 0.5 * (3 * np.log(prior) + 80 * np.log(noise) - error - np.linalg.slogdet(a)[1]), m

    best = max(((*log_evidence(p, n), p, n) for p in np.geomspace(0.05, 50, 160) for n in np.geomspace(0.5, 8, 160)), key=lambda t: t[0])
    assert np.allclose(beta[1:], best[1], atol=2e-3)
    assert np.isclose(beta[0], y.mean() - beta[1:] @ x.mean(axis=0))
    assert not regression_impute.evidence_solve(np.zeros((5, 5))).any()
    flat = np.column_stack([np.ones(9), np.zeros((9, 3)), np.full(9, 2.0)])
    assert np.allclose(regression_impute.evidence_solve(flat.T @ flat), [2.0, 0, 0, 0])


def test_evidence_as_ridge_of_the_chain(spark):
    x = table_of(8)
    got = regression_impute.grouped_regression(frame(spark, {1: x}), NAMES, ("g",), ridge="evidence", bounds=(-1.0, 1.0)).collect()
    filled = np.array([[r[f] for f in NAMES] for r in sorted(got, key=lambda r: r.pid)])
    known = ~np.isnan(x)
    assert np.isfinite(filled).all() and np.allclose(filled[known], x[known]) and np.abs(filled).max() < 2


def experiment(spark, reps=2, rates=(20, 50)):
    rng = np.random.default_rng(3)
    rows = [(p, t, f, float(rng.random()) if rng.random() < 0.9 else None) for p in range(8) for t in range(1, 5) for f in series.FEATURES]
    cells = spark.createDataFrame(rows, "pid long, step int, feature string, value double")
    return sampling.experiment_cells(cells, series.FEATURES, reps, rates)


def test_grouped_neighbours_equal_one_group_at_a_time(spark):
    cells = experiment(spark)
    together = {(r.rep, r.pct, r.pid, r.step, r.feature): r.imputed for r in knn_impute.fill_knn(cells, series.FEATURES, groups=("rep", "pct")).collect()}
    for rep, pct in ((0, 20), (1, 50)):
        alone = knn_impute.fill_knn(cells.where(f"rep = {rep} AND pct = {pct}"), series.FEATURES).collect()
        assert len(alone) == 8 * 4 * len(series.FEATURES)
        assert all(abs(together[rep, pct, r.pid, r.step, r.feature] - r.imputed) < 1e-12 for r in alone)


def test_grouped_log_has_all_methods_and_the_scores_of_the_grid(spark):
    cells = experiment(spark)
    log = impute.grouped_log(cells, series.grouped_methods()).collect()
    assert len(log) == 8 * 4 and len({r.method for r in log}) == 8
    assert all(r.seconds > 0 and r.rmse < 3 for r in log)
    grid = {(r.method, r.rep, r.pct): (r.rmse, r.cells) for r in impute.score_grid(cells, impute.column_methods(series.FEATURES)).collect()}
    found = {(r.method, r.rep, r.pct): (r.rmse, r.cells) for r in log}
    assert all(found[k][1] == v[1] and abs(found[k][0] - v[0]) < 1e-12 for k, v in grid.items()) and len(grid) == 5 * 4


@pytest.mark.parametrize("wanted", [0, 1, 7, 40, 1000])
def test_among_first_equals_ranks(spark, wanted):
    rows = spark.range(150).select("id", (F.col("id") % 4).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    for key in (hash_key(F.col("id")), F.lit(77).cast("long"), (F.col("id") % 3).cast("long")):
        keyed = rows.withColumn("k", key)
        got = {r.id for r in among_first(keyed, "k", ("id",), ("g",), F.lit(wanted), "in", F.col("v").isNotNull()).where("`in`").collect()}
        ranked = exact_rank(keyed.where("v IS NOT NULL"), "k", ("id",), ("g",))
        assert got == {r.id for r in ranked.where(F.col("rank") <= wanted).collect()}
    assert among_first(keyed, "k", ("id",), (), F.lit(wanted), "in").where("`in`").count() == min(wanted, 150)
    assert among_first(keyed.limit(0), "k", ("id",), ("g",), F.lit(wanted), "in").count() == 0


def test_amputation_shuffles_no_cell(spark):
    cells = experiment(spark).drop("masked", "truth", "rep", "pct")
    plan = sampling.amputate(cells, series.FEATURES)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "__last" in plan
    wide = gr.to_wide(cells, series.FEATURES)
    assert wide.count() == 32

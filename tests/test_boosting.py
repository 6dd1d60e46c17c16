"""Boosted trees against closed forms and a plain grower."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardframe.operators import boosting

INPUTS = ["a", "b", "c"]


def frame(spark, x, y, model="m"):
    rows = [(model, int(t), *[None if np.isnan(v) else float(v) for v in row]) for row, t in zip(x, y)]
    return spark.createDataFrame(rows, "model string, label int, " + ", ".join(f"{c} double" for c in INPUTS))


def table(seed, n=300):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, 3)).astype(float)
    x[rng.random((n, 3)) < 0.15] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=9) + 2 * (np.nan_to_num(x[:, 1]) > 6) * np.nan_to_num(x[:, 2]) + rng.normal(size=n) * 2 > 9).astype(int)
    return x, y


def plain_tree(x, g, h, depth, l2, rate, min_child, limits):
    """Recursive grower over raw values: (threshold tests) to margins."""
    value = -rate * g.sum() / (h.sum() + l2)
    best = (1e-9, None)
    if depth:
        for j in range(x.shape[1]):
            for limit in limits[j]:
                for null_left in (False, True):
                    with np.errstate(invalid="ignore"):
                        left = np.where(np.isnan(x[:, j]), null_left, x[:, j] <= limit)
                    gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                    if min(hl, hr) >= min_child:
                        gain = (gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)) / 2
                        if gain > best[0] + 1e-9:
                            best = (gain, left)
    out = np.full(len(x), value)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], g[side], h[side], depth - 1, l2, rate, min_child, limits)
    return out


def test_one_round_in_closed_form(spark):
    x = np.array([[1, 0, 0]] * 6 + [[2, 0, 0]] * 4, dtype=float)
    y = np.array([0, 0, 0, 0, 0, 1, 1, 1, 0, 1])
    model = boosting.fit_boosters(frame(spark, x, y), INPUTS, rounds=1, depth=1, rate=0.5, min_child=0.0)["m"]
    pos = 6 / 4  # negatives over positives

    def leaf(label):
        weight = np.where(label > 0, pos, 1.0)
        g, h = (weight * (0.5 - label)).sum(), (weight * 0.25).sum()
        return -0.5 * g / (h + 1)

    got = model.margins(np.array([[1.0, 0, 0], [2.0, 0, 0]]))
    assert np.allclose(got, [leaf(y[:6]), leaf(y[6:])])


@pytest.mark.parametrize(("depth", "min_child"), [(1, 0.0), (3, 1.0)])
def test_rounds_equal_a_plain_grower(spark, depth, min_child, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_ROUNDS", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    monkeypatch.setattr(boosting, "TASK_BLOCKS", 4 if depth > 1 else 1000)
    x, y = table(1)
    model = boosting.fit_boosters(frame(spark, x, y).repartition(3), INPUTS, rounds=5, depth=depth, rate=0.4, min_child=min_child)["m"]
    weight = np.where(y > 0, (len(y) - y.sum()) / y.sum(), 1.0)
    margin = np.zeros(len(x))
    for _ in range(5):
        p = 1 / (1 + np.exp(-margin))
        margin += plain_tree(x, weight * (p - y), weight * p * (1 - p), depth, 1.0, 0.4, min_child, model.bounds)
    found = model.margins(x)
    # Splits of equal gain may fall differently; margins then differ for few rows.
    assert np.mean(np.abs(found - margin) < 1e-6) > 0.97
    loss = lambda m: np.mean(weight * np.log1p(np.exp(-(2 * y - 1) * m)))
    assert abs(loss(found) - loss(margin)) < 1e-3 < loss(np.zeros(len(x))) - loss(found)


def test_models_side_by_side_equal_models_alone(spark):
    (x1, y1), (x2, y2) = table(2, 120), table(3, 90)
    one, two = frame(spark, x1, y1, "one"), frame(spark, x2, y2, "two")
    flat = frame(spark, x1[:20], np.zeros(20), "flat")
    unknown = two.limit(3).withColumn("label", F.lit(None).cast("int"))
    both = boosting.fit_boosters(one.union(two).union(flat).union(unknown), INPUTS, rounds=3, depth=3)
    assert not both["flat"].trees and np.allclose(both["flat"].margins(x1), 0.0)
    for name, rows, x in (("one", one, x1), ("two", two, x2)):
        alone = boosting.fit_boosters(rows, INPUTS, rounds=3, depth=3)[name]
        assert np.allclose(both[name].margins(x), alone.margins(x))
    assert boosting.fit_boosters(one.limit(0), INPUTS, rounds=1) == {}


def test_saved_booster_scores_alike(spark, tmp_path):
    x, y = table(4, 150)
    rows = frame(spark, x, y)
    model = boosting.fit_boosters(rows, INPUTS, rounds=4, depth=4)["m"]
    boosting.save_booster(spark, model, str(tmp_path / "booster"))
    again = boosting.load_booster(spark, str(tmp_path / "booster"))
    assert np.allclose(model.margins(x), again.margins(x))
    scored = boosting.score(again, rows).collect()
    assert np.allclose(sorted(r.score for r in scored), np.sort(1 / (1 + np.exp(-model.margins(x)))))
    assert boosting.score(again, rows.limit(0)).count() == 0

"""Rolling models against NumPy, fold by fold."""

import numpy as np
import pytest

from touchline.operators import rolling

WINDOW = 3


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    out = []
    for r in range(9):
        for i in range(rng.integers(4, 12)):
            x = rng.normal(size=3) * [1, 5, 0.1] + [0, 3, 1]
            y = float(rng.random() < 1 / (1 + np.exp(-(x[0] + 0.2 * x[1] - 0.6)))) if r < 7 else 1.0
            out.append((r, 100 * r + i, None if i == 3 and r == 2 else y, [*x[:2].tolist(), None if i == 1 else float(x[2])], "clash"))
    return out


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "round_index long, match_id long, y double, features array<double>, fold2 string")


def training(data, fold):
    some = [(x, y) for r, _, y, x, _ in data if fold - WINDOW <= r < fold and y is not None]
    return np.array([[v or 0.0 for v in x] for x, _ in some]), np.array([y for _, y in some])


def folds(data):
    return range(WINDOW, max(r for r, *_ in data) + 1)


def test_ridge(rows, data):
    got = {r.fold: np.array(r.w) for r in rolling.ridge_weights(rows, WINDOW, 2.0).collect()}
    assert set(got) == set(folds(data))
    for fold in folds(data):
        x, y = training(data, fold)
        mean, spread = x.mean(0), x.std(0)
        z = (x - mean) / spread
        w = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean())) / spread
        assert got[fold] == pytest.approx(np.concatenate([[y.mean() - w @ mean], w]), abs=1e-8)


def plain_logistic(x, y, c, balanced, free):
    mean, spread = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    lam, w = np.diag([0.0 if free else 1.0, 1, 1, 1]) / c, np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + lam, z.T @ (weight * (p - y)) + lam @ w)
    return 1 / (1 + np.exp(-((np.column_stack([np.ones(len(x)), (x - mean) / spread])) @ w))), lambda v: 1 / (1 + np.exp(-(np.concatenate([[1], (v - mean) / spread]) @ w)))


@pytest.mark.parametrize(("c", "balanced", "free"), [(1.0, False, False), (0.3, True, True)])
def test_logistic(rows, data, c, balanced, free):
    weights = rolling.logistic_weights(rows, WINDOW, c, balanced, free)
    got = {(r.fold, r.match_id): r.prediction for r in rolling.predicted(rows, weights, "logit").collect()}
    assert len(got) == sum(r >= WINDOW for r, *_ in data)
    for r, i, _, x, _ in data:
        if r >= WINDOW:
            tx, ty = training(data, r)
            want = ty[0] if len(set(ty)) == 1 else plain_logistic(tx, ty, c, balanced, free)[1](np.array([v or 0.0 for v in x]))
            assert got[r, i] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("limits", [{"HELD": 0}, {"STRETCH": 1}, {"STRETCH": 2, "AT_ONCE": 1}, {"HELD": 8 * 11 * 6 * (WINDOW + 2)}])
def test_logistic_by_sums_and_in_stretches(rows, data, limits, monkeypatch):
    whole = {r.fold: r.w for r in rolling.logistic_weights(rows, WINDOW, 0.3, True, False).collect()}
    for k, v in limits.items():
        monkeypatch.setattr(rolling, k, v)
    got = {r.fold: r.w for r in rolling.logistic_weights(rows, WINDOW, 0.3, True, False).collect()}
    assert got.keys() == whole.keys() == set(folds(data))
    assert all(got[k] == pytest.approx(whole[k], abs=1e-6) for k in got)


def test_newton_steps_of_a_stretch_need_one_shuffle(rows):
    made = rolling.logistic_weights(rows, WINDOW, free_intercept=False)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rolling.logistic_weights(rows.where("round_index <> 4"), 1).where("fold = 5").count() == 0  # no training rows


def test_majority_and_metrics(rows, data):
    got = {r.match_id: r for r in rolling.majority(rows, WINDOW, 2).collect()}
    assert len(got) == sum(r >= WINDOW for r, *_ in data)
    for r, i, _, _, _ in data:
        if r >= WINDOW:
            y = training(data, r)[1]
            assert (got[i].n, got[i].mean) == (len(y), pytest.approx(y.mean())) and got[i].dist == pytest.approx([1 - y.mean(), y.mean()])
            assert got[i].top == int(y.mean() > 0.5) and got[i].expected == pytest.approx(y.mean())
    scored = rows.selectExpr("round_index as fold", "y", "0.25D as prediction")
    metrics = {r.fold: r for r in rolling.fold_metrics(scored).collect()}
    ys = np.array([y for _, _, y, _, _ in data if y is not None])
    assert metrics[None].n == len(ys) and metrics[None].mae == pytest.approx(np.abs(ys - 0.25).mean()) and metrics[None].rmse == pytest.approx(np.sqrt(((ys - 0.25) ** 2).mean()))


def test_spark_estimators_by_fold(rows, data):
    trees = rolling.fitted_by_fold(rows, [4, 5], WINDOW, rolling.forest(5, 3, 1)).collect()
    assert {r.fold for r in trees} == {4, 5} and all(0 <= r.probability <= 1 for r in trees)
    dist = rolling.fitted_by_fold(rows, [5], WINDOW, rolling.multinomial(4)).collect()
    assert all(len(r.dist) == 4 and sum(r.dist) == pytest.approx(1) and r.dist[2:] == [0, 0] for r in dist)
    used = []
    nets = rolling.fitted_by_fold(rows, [3, 4], WINDOW, rolling.layered([3, 4, 2], lambda fold: used.append(fold) or 0.03, 15, 3))
    assert {r.fold for r in nets.collect()} == {3, 4} and set(used) == {3, 4} and nets.columns[-2:] == ["probability", "fold"]


def test_empty_tables_and_trial_folds(rows, spark):
    none = rows.limit(0)
    assert rolling.ridge_weights(none, WINDOW).count() == 0 and rolling.logistic_weights(none, WINDOW).count() == 0 and rolling.majority(none, WINDOW, 3).count() == 0
    assert rolling.first_folds(rows, 3, 2, 1) == [4, 5] and rolling.first_folds(rows, 8, 5) == [8] and rolling.first_folds(none, 3, 2) == []
    assert rolling.fitted_by_fold(rows, [], WINDOW, rolling.forest()).count() == 0


def test_blocks_are_worked_on_few_at_a_time():
    import pandas as pd

    now = [{"fold": 9, "w": [0.0, 0.0], "n": 2.0, "positives": 1.0}] * 3
    frame = pd.DataFrame({"round_index": range(150), "n": 2, "x": [[1.0, 2.0]] * 150, "t": [[0.0, 1.0]] * 150, "folds": [now] * 150})
    made = list(rolling._curved(iter([frame]), False))
    assert [len(f) for f in made] == [192, 192, 66]

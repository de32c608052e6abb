import dataclasses
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import kernel, scoring, signature, walkforward
from causeway.plans.config import ForecastConfig

#: Fixed values of the fixtures.
CONFIG = ForecastConfig(window=10, signature_depth=2, regime_depth=2, regime_gamma=0, lasso_alpha=1e-5, correlation_min=0.05, max_train=200)


def market(n=290, seed=17):
    rng = np.random.default_rng(seed)
    f = rng.normal(size=n)
    ret = 0.004 * f + 0.001 * np.roll(f, 1) + rng.normal(scale=0.004, size=n)
    return ret, 100 * np.exp(np.cumsum(ret)), np.column_stack((f, rng.normal(size=n))).astype(np.float32)


def frame(spark, ret, close, factors):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([("A", i, day + dt.timedelta(i), float(c), float(r), [float(x) for x in f]) for i, (r, c, f) in enumerate(zip(ret, close, factors))], "series string, idx long, session date, close double, ret double, factors array<float>")


def predictions(spark, predicted, actual):
    return spark.createDataFrame([(float(p), float(a)) for p, a in zip(predicted, actual)], "predicted_return double, actual_return double")


def test_separate_cutoffs_and_neutral_recall(spark):
    df = predictions(spark, [0.004, -0.005, 0.001, -0.002, 0, 0.0015], [0.003, -0.004, 0.002, -0.003, -0.001, -0.001])
    said = [r[0] for r in df.select(scoring.direction(F.col("predicted_return"), 0.001, -0.002)).collect()]
    assert said == [1, -1, 0, -1, 0, 1]
    row = scoring.scores(df, 0.001, -0.002).first()
    assert (row["accuracy"], row["up_recall"], row["down_recall"], row["up_precision"], row["down_precision"]) == (0.5, 0.5, 0.5, 0.5, 1.0)
    assert row["predicted_up_rate"] + row["predicted_down_rate"] + row["neutral_rate"] == pytest.approx(1)


@pytest.mark.parametrize("cut", [0, 0.001, -0.001])
def test_one_cutoff_is_a_binary_rule(spark, cut):
    p, a = np.array([-0.003, 0, 0.001, 0.003]), np.array([-0.002, 0, 0.002, -0.001])
    row = scoring.scores(predictions(spark, p, a), cut).first()
    assert row["accuracy"] == np.mean((p > cut) == (a > 0)) and row["neutral_days"] == 0


def test_precision_without_forecasts_is_null(spark):
    row = scoring.scores(predictions(spark, [0, 0], [0.001, -0.001]), 0.001, -0.001).first()
    assert row["up_precision"] is None and row["down_precision"] is None


@pytest.mark.parametrize("up, down", [(math.nan, 0), (0, math.inf), (-0.001, 0.001)])
def test_bad_cutoffs(up, down):
    with pytest.raises(ValueError):
        scoring.direction(None, up, down)


def test_line_and_order():
    assert signature.batch(np.array([[[0], [0.3], [1]]]), 3)[0] == pytest.approx([1, 0.5, 1 / 6])
    xy, yx = signature.batch(np.array([[[0, 0], [1, 0], [1, 1]], [[0, 0], [0, 1], [1, 1]]], dtype=float), 2)
    assert xy[3] == pytest.approx(1) and yx[3] == pytest.approx(0)


def test_signature_forms_agree(spark):
    rng = np.random.default_rng(5)
    paths = rng.normal(size=(6, 7, 2)).cumsum(axis=1)
    want = signature.batch(paths, 3)
    points = spark.createDataFrame([(i, k, float(p[0]), float(p[1])) for i, path in enumerate(paths) for k, p in enumerate(path)], "path int, pos int, x double, y double")
    got = signature.by_window(points, ["x", "y"], 3, path=["path"]).orderBy("path").collect()
    assert np.array([[r[c] for c in signature.coordinate_names(2, 3)] for r in got]) == pytest.approx(want, abs=1e-9)
    arrays = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(paths)], "path int, p array<array<double>>")
    got = arrays.select("path", signature.by_functions(F.col("p"), 2, 3).alias("h"), signature.by_arrow(3)(F.col("p")).alias("a")).orderBy("path").collect()
    assert np.array([r["h"] for r in got]) == pytest.approx(want, abs=1e-9)
    assert np.array([r["a"] for r in got]) == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_signature_translation_and_chen():
    rng = np.random.default_rng(6)
    path = rng.normal(size=(1, 9, 2)).cumsum(axis=1)
    whole = signature.batch(path, 2)[0]
    assert signature.batch(path + 3, 2)[0] == pytest.approx(whole)
    a, b = signature.batch(path[:, :5], 2)[0], signature.batch(path[:, 4:], 2)[0]
    assert whole[:2] == pytest.approx(a[:2] + b[:2])
    assert whole[2:] == pytest.approx(a[2:] + b[2:] + np.outer(a[:2], b[:2]).ravel())


def test_collinear_factors_are_pruned():
    rng = np.random.default_rng(3)
    y = rng.normal(size=250)
    x = np.column_stack((y + 0.02 * rng.normal(size=250), y + 0.02 * rng.normal(size=250), rng.normal(size=250)))
    chosen = kernel.choose_factors(x, y, ForecastConfig(correlation_min=0.2, collinearity_max=0.9))
    assert len(set(chosen) & {0, 1}) == 1 and abs(np.corrcoef(x[:, chosen[0]], y)[0, 1]) > 0.9


def inputs(at, config=CONFIG, change=0.0):
    ret, close, factors = market()
    w, h = config.window, config.horizon
    y_paths, x_paths = walkforward.samples_of(close, factors.astype(float), w)
    label = np.log(close[h:]) - np.log(close[:-h])
    label[at - h + 1 :] += change
    rows = np.append(np.arange(max(w - 1, at - h - config.max_train + 1), at - h + 1), at)
    sig = signature.batch(y_paths, config.signature_depth)
    return factors[rows].astype(float), ret[rows], label[rows[:-1]], sig[rows - w + 1], x_paths[rows - w + 1], y_paths[rows - w + 1]


def fit_one(at, change=0.0, config=CONFIG):
    return kernel.fit(*inputs(at, config, change), config)


def naive_weights(x, y, x_paths, y_paths, gamma):
    """Regime weights of depth 2 by plain loops."""
    n, w, k = x_paths.shape
    seen = []
    for i in range(n):
        path = [[y_paths[i, t, 0], y_paths[i, t, 1] / max(y[:-1].std() * math.sqrt(w), 1e-4)] for t in range(w)]
        for j in range(k):
            moves = [min(8, max(-8, x_paths[i, t, j] / max(x[:-1, j].std(), 1e-5))) for t in range(w)]
            for t in range(w):
                path[t].append(moves[t] - moves[0])
        d = k + 2
        one, two = [0.0] * d, [[0.0] * d for _ in range(d)]
        for p, q in zip(path, path[1:]):
            step = [v - u for u, v in zip(p, q)]
            for a in range(d):
                for b in range(d):
                    two[a][b] += one[a] * step[b] + step[a] * step[b] / 2
            one = [u + v for u, v in zip(one, step)]
        seen.append(one + [v for row in two for v in row])
    seen = np.array(seen, dtype=np.float32).astype(float)
    mean, sd = seen[:-1].mean(axis=0), np.maximum(seen[:-1].std(axis=0), 1e-5)
    z = np.minimum(8, np.maximum(-8, (seen - mean) / sd))
    raw = [math.exp(-gamma * sum((u - v) ** 2 for u, v in zip(row, z[-1])) / len(row)) for row in z[:-1]]
    return np.array(raw) / sum(raw)


@pytest.mark.parametrize("change", [{"regime_gamma": 0.5}, {"regime_gamma": 1.0, "horizon": 4}, {"regime_gamma": 2.0, "max_selected": 2, "collinearity_max": 0.99, "correlation_min": 0.0}])
def test_fit_against_its_definition(change):
    config = dataclasses.replace(CONFIG, **change)
    x, y, target, sig, x_paths, y_paths = inputs(250, config)
    got = kernel.fit(x, y, target, sig, x_paths, y_paths, config)
    near = got.chosen[: config.regime_factors]
    weight = naive_weights(x[:, near], y, x_paths[:, :, near], y_paths, config.regime_gamma)
    assert got.model.weight == pytest.approx(weight, rel=1e-6) and weight.max() > 1.5 * weight.min()

    features = np.column_stack((x[:, got.chosen], sig))
    mean = sum(w * f for w, f in zip(weight, features))
    sd = np.maximum(np.sqrt(sum(w * (f - mean) ** 2 for w, f in zip(weight, features))), 1e-5)
    z = np.minimum(8, np.maximum(-8, (features - mean) / sd))
    z = z - sum(w * f for w, f in zip(weight, z))
    past, level = z[:-1], float(np.dot(weight, target))
    # The Lasso's conditions of optimality, at its own solution.
    gram, moment = past.T @ (weight[:, None] * past), past.T @ (weight * (target - level))
    beta = kernel.lasso(gram, moment, config.lasso_alpha, 5000)
    slope = moment - gram @ beta
    on = np.abs(beta) > 1e-10
    assert np.abs(slope).max() <= config.lasso_alpha + 1e-7 and slope[on] == pytest.approx(config.lasso_alpha * np.sign(beta[on]), abs=1e-7)
    short = kernel.lasso(gram, moment, config.lasso_alpha, config.lasso_passes)
    largest = sorted(np.flatnonzero(np.abs(short) > 1e-10), key=lambda k: -abs(short[k]))[: config.max_selected]
    assert got.support.tolist() == sorted(largest) and (len(largest) == 2 or "max_selected" not in change)
    # Weighted least squares on the support, and the issue's own row.
    own = past[:, got.support]
    root = np.sqrt(weight)[:, None]
    coefficients = np.linalg.lstsq(root * own, root[:, 0] * (target - level), rcond=1e-8)[0]
    assert got.predicted_return == pytest.approx(level + float(z[-1, got.support] @ coefficients), rel=1e-6, abs=1e-10)


def test_second_step_is_weighted_least_squares():
    got = fit_one(250)
    off = np.setdiff1d(np.arange(len(got.beta)), got.support)
    residual = got.model.centred - got.model.z @ got.beta
    assert not got.beta[off].any()
    assert np.abs(got.model.z[:, got.support].T @ (got.model.weight * residual)).max() < 1e-8
    assert got.model.weight.sum() == pytest.approx(1)


def test_candidates_side_by_side_and_selection(spark):
    """All candidates of a task give what each gives alone, and the one with the smallest error comes first."""
    panel = frame(spark, *market())
    several = {"a": CONFIG, "b": dataclasses.replace(CONFIG, signature_depth=3, window=12, regime_gamma=1.0), "c": dataclasses.replace(CONFIG, horizon=3, max_train=120)}
    both = walkforward.forecasts(panel, several, first=150, last=200, chunk=16)
    rows = {(r["candidate"], r["issue_idx"]): r for r in both.collect()}
    for name, config in several.items():
        alone = {r["issue_idx"]: r["predicted_return"] for r in walkforward.forecasts(panel, {name: config}, first=150, last=200, chunk=64).collect()}
        assert len(alone) == 51 and {i: r["predicted_return"] for (n, i), r in rows.items() if n == name} == pytest.approx(alone)
    assert rows["c", 170]["predicted_return"] == pytest.approx(kernel.fit(*inputs(170, several["c"]), several["c"]).predicted_return, abs=1e-9)
    want = []
    for name in several:
        mine = [r for (n, _), r in rows.items() if n == name]
        error = np.array([r["actual_return"] - r["predicted_return"] for r in mine])
        hits = np.mean([(r["actual_return"] > 0) == (r["predicted_return"] > 0) for r in mine])
        want.append((np.abs(error).mean(), name, hits, np.sqrt((error**2).mean()), np.median([r["lasso_support_count"] for r in mine]), np.median([r["effective_train_n"] for r in mine])))
    got = [(r["validation_return_mae"], r["candidate"], r["validation_direction_accuracy"], r["validation_return_rmse"], r["median_lasso_support"], r["median_effective_train_n"]) for r in walkforward.selection(both).collect()]
    assert [g[1] for g in got] == [w[1] for w in sorted(want)]
    assert [x for g in got for x in g if not isinstance(x, str)] == pytest.approx([x for w in sorted(want) for x in w if not isinstance(x, str)])


def test_gaps_in_the_numbers_are_refused(spark):
    panel = frame(spark, *market()).where("idx <> 140")
    with pytest.raises(Exception, match="not numbered one after another"):
        walkforward.forecasts(panel, {"x": CONFIG}, first=150, last=160).collect()


def test_signatures_of_defective_paths_are_null(spark):
    rows = [(0, [[0.0, 0.0], [1.0, 0.5]]), (1, None), (2, [[0.0, 0.0]]), (3, [[0.0, 0.0], None]), (4, [[0.0, None], [1.0, 1.0]]), (5, [[0.0], [1.0, 2.0]]), (6, []), (7, [[0.0, 0.0], [0.5, 1.0], [1.0, 0.5]])]
    paths = spark.createDataFrame(rows, "id int, path array<array<double>>")
    got = {r["id"]: r["s"] for r in paths.select("id", signature.by_arrow(2)(F.col("path")).alias("s")).collect()}
    assert [i for i, s in got.items() if s is not None] == [0, 7]
    assert got[7] == pytest.approx(signature.batch(np.array([rows[7][1]]), 2)[0], rel=1e-6)


def test_later_labels_do_not_change_a_forecast(spark):
    assert fit_one(250).predicted_return == fit_one(250, 4.0).predicted_return
    ret, close, factors = market()
    run = lambda c, last: {r["issue_idx"]: r["predicted_return"] for r in walkforward.forecasts(frame(spark, ret, c, factors), {"x": CONFIG}, first=0, last=last).collect()}
    later = close.copy()
    later[251:] *= 1.5
    assert run(close, 250)[250] == run(later, 250)[250]


def test_chunks_do_not_change_forecasts(spark):
    panel = frame(spark, *market())
    rows = [{r["issue_idx"]: r["predicted_return"] for r in walkforward.forecasts(panel.orderBy(F.rand(1)), {"x": CONFIG}, first=0, chunk=c).collect()} for c in (7, 64)]
    assert rows[0] == pytest.approx(rows[1]) and min(rows[0]) == 9 + 100 and max(rows[0]) == 288
    assert rows[0][250] == pytest.approx(fit_one(250).predicted_return, abs=1e-9)


def test_price_uses_the_previous_close(spark):
    days = [dt.date(2024, 1, 2 + i) for i in range(4)]
    prices = spark.createDataFrame(list(zip(days, [100.0, 110.0, 90.0, 99.0])), "session date, close double")
    rows = spark.createDataFrame([(days[1], days[2], math.log(90 / 110), math.log(1.1)), (days[2], days[3], math.log(99 / 90), math.log(1.1))], "issue_date date, target_date date, actual_return double, predicted_return double")
    got = [r["predicted_close"] for r in scoring.reconstructed_prices(rows, prices).orderBy("issue_date").collect()]
    assert got == pytest.approx([121, 99])


def test_config_ranges():
    with pytest.raises(ValueError):
        ForecastConfig(signature_depth=5).check()
    for bad in ({"correlation_min": 1.0}, {"collinearity_max": 0.0}, {"lasso_alpha": -1.0}, {"max_train": 99}):
        with pytest.raises(ValueError):
            ForecastConfig(**bad).check()
    assert ForecastConfig(correlation_min=0.0, collinearity_max=1.0).check()

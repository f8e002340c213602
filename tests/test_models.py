"""Learners, bands, fleets: against numpy, and by invariants."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import baselines, fleet, intervals, learners, metrics, origins, trees
from tests.helpers import frame, pandas_of, stride_series

HOUR = 3600


def xy(spark, n=400, p=4, m=2, seed=0, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    rows, raw = [], {}
    for k in keys:
        x = rng.normal(0, 1, (n, p)) * np.array([1, 10, 100, 0.1][:p]) + 5
        y = x @ rng.normal(0, 1, (p, m)) + 3 + rng.normal(0, 0.1, (n, m))
        raw[k] = (x, y)
        rows += [(k, a.tolist(), b.tolist()) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "series_id string, x array<double>, y array<double>").repartition(7), raw


def test_fit_linear_equals_least_squares(spark):
    df, raw = xy(spark)
    got = {(r["series_id"], r["h"]): r["w"] for r in learners.fit_linear(df, ["series_id"]).collect()}
    for k, (x, y) in raw.items():
        want = np.linalg.lstsq(np.hstack([np.ones((len(x), 1)), x]), y, rcond=None)[0]
        for h in (1, 2):
            assert np.allclose(got[k, h], want[:, h - 1], rtol=1e-6, atol=1e-6)


def test_fit_linear_flushes_many_keys(spark, monkeypatch):
    monkeypatch.setattr(learners, "HELD_BYTES", 1)
    df, raw = xy(spark, n=50)
    assert learners.fit_linear(df, ["series_id"]).count() == 4


def test_ridge_penalises_slopes_only(spark):
    df, raw = xy(spark, m=1)
    got = {r["series_id"]: r["w"] for r in learners.fit_linear(df, ["series_id"], ridge=25.0).collect()}
    for k, (x, y) in raw.items():
        xc, yc = x - x.mean(0), y - y.mean(0)
        w = np.linalg.solve(xc.T @ xc + 25 * np.eye(x.shape[1]), xc.T @ yc)[:, 0]
        assert np.allclose(got[k][1:], w, rtol=1e-6, atol=1e-7)
        assert np.isclose(got[k][0], y.mean() - x.mean(0) @ w)


def test_collinear_features_stay_finite(spark):
    x = np.arange(60.0)
    rows = [("a", [v, 2 * v, 1.0], [3 * v + 1]) for v in x.tolist()]
    df = spark.createDataFrame(rows, "series_id string, x array<double>, y array<double>")
    w = learners.fit_linear(df, ["series_id"]).first()["w"]
    assert np.allclose([w[0] + w[1] * v + w[2] * 2 * v + w[3] for v in x], 3 * x + 1, atol=1e-4)


def test_unknown_tree_parameters_are_refused():
    with pytest.raises(ValueError):
        trees.settings({"no_such": 1})
    with pytest.raises(ValueError):
        trees.settings({"max_depth": 0})


def test_residual_correction_against_closed_form(spark):
    rng = np.random.default_rng(2)
    t = pd.date_range("2024-01-01", periods=300, freq="h")
    temp = 10 + 12 * np.sin(np.arange(300) / 24)
    load = 50 + 2 * np.maximum(0, 18 - temp) + rng.normal(0, 0.5, 300)
    readings = frame(spark, pd.DataFrame({"series_id": "a", "ts": t, "load": load, "temperature": temp}), "series_id string, ts timestamp_ntz, load double, temperature double")
    base = readings.select("series_id", F.lit("Base").alias("model"), F.col("ts").alias("origin_ts"), F.lit(1).alias("h"), "ts", F.lit(50.0).alias("yhat"))
    from gridcast.operators.features import temperature_knots

    cut = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    got = pandas_of(learners.residual_correction(base, readings, ["temperature", "absent"], cut, 1.0, "temperature", temperature_knots(readings, "temperature")))
    knots = np.percentile(temp, [10, 50, 90])
    feats = np.column_stack([temp, 0 * temp, np.maximum(0, 18 - temp), np.maximum(0, temp - 22), *[np.maximum(0, temp - k) ** 3 for k in knots]])
    n = int((t < pd.Timestamp("2024-01-10")).sum())
    m, s = feats[:n].mean(0), feats[:n].std(0)
    z = (feats - m) / np.where(s > 0, s, 1)
    r = (load - 50)[:n]
    w = np.linalg.solve(z[:n].T @ z[:n] + np.eye(z.shape[1]), z[:n].T @ (r - r.mean()))
    assert np.allclose(got["yhat"], 50 + r.mean() + z @ w, atol=1e-6)
    assert (got["yhat"] - load).abs().mean() < (50 - load).__abs__().mean() / 4


def test_linear_beats_naive_and_strides_agree(spark):
    df = frame(spark, stride_series(1500)).cache()
    grid = fleet.prepare(df, HOUR)

    def m(model, stride):
        # fitted on the first month; a yearly cycle cannot be learnt from that, so no calendar features
        extra = {"calendar_static": False} if model == "LinearRegression" else {}
        f = fleet.forecast(grid, HOUR, model, 48, 24, stride=stride, start_fraction=0.5, **extra)
        return metrics.point_metrics(metrics.score(f, grid)).first()

    naive, by = m("NaiveSeasonal", 24), {s: m("LinearRegression", s) for s in (24, 12, 6)}
    assert by[24]["mape"] < 15 and by[24]["r_squared"] > 0.5 and by[24]["rmse"] < naive["rmse"]
    values = [r["mape"] for r in by.values()]
    assert max(values) / min(values) < 1.35
    flat = metrics.flatten(metrics.score(fleet.forecast(grid, HOUR, "NaiveSeasonal", 48, 24, stride=6), grid))
    assert flat.groupBy("series_id", "ts").count().where("count > 1").count() == 0


def noise(n=900, seed=4):
    t = pd.date_range("2024-01-01", periods=n, freq="h")
    return pd.DataFrame({"series_id": "n", "ts": t, "load": np.random.default_rng(seed).normal(100, 10, n)})


@pytest.mark.parametrize("model", ["LinearRegression", "ARIMA"])
def test_nothing_is_learnt_from_what_is_scored(spark, model):
    pdf = noise()
    params = {"p": 2, "d": 0}

    def forecasts(d):
        grid = fleet.prepare(frame(spark, d), HOUR)
        f = fleet.forecast(grid, HOUR, model, 6, 4, params=params)
        return grid, f, pandas_of(f, "origin_ts", "h")

    grid, f, one = forecasts(pdf)
    assert metrics.point_metrics(metrics.score(f, grid)).first()["r_squared"] <= 0.05
    first = one["origin_ts"].min()
    changed = pdf.copy()
    changed.loc[changed["ts"] >= first, "load"] *= 3
    two = forecasts(changed)[2]
    same = one["origin_ts"] == first
    assert np.allclose(one.loc[same, "yhat"], two.loc[same, "yhat"])


@pytest.mark.parametrize("model", ["LinearRegression", "ARIMA"])
def test_a_stored_fit_forecasts_other_readings(spark, model, tmp_path):
    pdf = stride_series(900)
    early, late = frame(spark, pdf[:600]), frame(spark, pdf[600:])
    out = fleet.train_fleet(early, HOUR, model, 24, 6)
    out["fitted"].write.parquet(str(tmp_path / "fit"))
    stored = spark.read.parquet(str(tmp_path / "fit"))
    with pytest.raises(ValueError):
        fleet.evaluate(late, HOUR, model, 24, 6)
    got = fleet.evaluate(late, HOUR, model, 24, 6, fitted=stored)
    assert got["metrics"].first()["n"] > 0
    ahead = fleet.forward_forecast(early, HOUR, 6, model, fitted=stored)
    fresh = fleet.forecast(fleet.prepare(late, HOUR), HOUR, model, 24, 6, fitted=stored)
    assert ahead.count() == 6 and fresh.where("yhat is null").count() == 0


def tree_rows(spark, n=700):
    df = frame(spark, stride_series(n))
    g = origins.mark_origins(fleet.prepare(df, HOUR), HOUR, 24, 6)
    return origins.supervised(g, HOUR, 24, 6, keep_open=True)


def test_trees_fit_and_record_a_curve(spark):
    rows = tree_rows(spark)
    fit = rows.where("fit_ok")
    models = trees.fit_boosted(fit, 6, [{"n_estimators": 4, "max_depth": 3}])
    f = trees.predict_boosted(models, rows.where("is_origin"), HOUR)
    assert set(r["h"] for r in f.select("h").distinct().collect()) == set(range(1, 7))
    curve = pandas_of(trees.learning_curve(models, fit, fit, 6), "model_id", "x")
    assert len(curve) == 24 and (curve.groupby("model_id")["train"].last() < curve.groupby("model_id")["train"].first()).all()
    assert np.allclose(curve["train"], curve["val"])


def grown_by_hand(x, y, edges, rounds, depth, rate):
    """Boosting with exhaustive split search over the same candidate thresholds."""
    guess = np.full(len(y), y.mean())
    for _ in range(rounds):
        residual, node, step = y - guess, [np.arange(len(y))], np.zeros(len(y))
        for level in range(depth + 1):
            after = []
            for rows in node:
                r, best = residual[rows], (1e-9, None)
                step[rows] = rate * r.sum() / (len(r) + trees.RIDGE)
                for f in range(x.shape[1]) if level < depth else ():
                    for c in edges[f]:
                        left = x[rows, f] <= c
                        if left.any() and not left.all():
                            a, b = r[left], r[~left]
                            gain = a.sum() ** 2 / (len(a) + 1) + b.sum() ** 2 / (len(b) + 1) - r.sum() ** 2 / (len(r) + 1)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, left)
                if best[1] is not None:
                    after += [rows[best[1]], rows[~best[1]]]
            node = after
        guess = guess + step
    return guess


def test_trees_equal_an_exhaustive_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 3)).round(3)
    y = np.stack([np.sin(3 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0), x[:, 1] ** 2], 1)
    rows = spark.createDataFrame([("s", datetime(2024, 1, 1) + timedelta(hours=i), a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "series_id string, ts timestamp_ntz, x array<double>, y array<double>").repartition(3)
    conf = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.5}
    edges = trees.bin_edges(rows, 3)
    for local_bytes in (None, 0):  # all rows in each task, and rows spread over tasks
        models = trees.fit_boosted(rows, 2, [conf], local_bytes=local_bytes)
        f = pandas_of(trees.predict_boosted(models, rows, HOUR), "h", "origin_ts")
        for h in (1, 2):
            want = grown_by_hand(x, y[:, h - 1], edges, 3, 3, 0.5)
            assert np.allclose(f.loc[f["h"] == h, "yhat"], want, atol=1e-9)


def test_spread_and_local_trees_agree(spark, monkeypatch):
    fit = tree_rows(spark, 500).where("fit_ok").repartition(5)
    trials = [{"n_estimators": 6, "max_depth": 4, "subsample": 0.7, "colsample_bytree": 0.5}, {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3}]
    monkeypatch.setattr(trees, "MODELS_AT_ONCE", 5)
    one, two = (pandas_of(trees.fit_boosted(fit, 3, trials, local_bytes=b), "trial", "h", "round") for b in (None, 0))
    assert len(one) == 3 * (7 + 3) and one["feature"].apply(list).equals(two["feature"].apply(list))
    assert all(np.allclose(a, b) for c in ("threshold", "value") for a, b in zip(one[c], two[c]))


def test_trees_without_rows_give_no_forecast(spark):
    rows = tree_rows(spark, 300)
    none = trees.fit_boosted(rows.where("false"), 6)
    assert none.count() == 0 and trees.predict_boosted(none, rows.where("is_origin"), HOUR).count() == 0


def test_trees_learn_a_cycle_out_of_sample(spark):
    grid = fleet.prepare(frame(spark, stride_series(1500)), HOUR)
    f = fleet.forecast(grid, HOUR, "GradientBoosting", 24, 24, start_fraction=0.5)
    m = metrics.point_metrics(metrics.score(f, grid)).first()
    assert m["mape"] < 15 and m["r_squared"] > 0.5
    first = f.agg(F.min("origin_ts")).first()[0]
    changed = stride_series(1500)
    changed.loc[changed["ts"] >= first, "load"] *= 3
    again = fleet.forecast(fleet.prepare(frame(spark, changed), HOUR), HOUR, "GradientBoosting", 24, 24, start_fraction=0.5)
    same = F.col("origin_ts") == F.lit(first)
    assert np.allclose(pandas_of(f.where(same), "h")["yhat"], pandas_of(again.where(same), "h")["yhat"])


def test_shared_trials_equal_single_fits(spark):
    df = frame(spark, stride_series(600))
    space = {"p": {"type": "int", "low": 1, "high": 3}, "d": {"type": "categorical", "choices": [0, 1]}}
    trials = fleet.tune(df, HOUR, "ARIMA", 24, 6, space, n_trials=5).collect()
    assert [r.trial for r in trials] == list(range(5)) and all(r.cv_rmse > 0 for r in trials)
    split, _ = fleet._search_split(df, HOUR, 24, 6)
    train = F.col("role") == "training"
    shared = baselines.fit_autoregressions(split, HOUR, [(3, 0), (1, 0), (2, 1)], train)
    for p, d in ((3, 0), (2, 1)):  # the largest order of each difference has the rows of a fit of its own
        own = baselines.fit_autoregression(split, HOUR, p, d, train=train).first()["w"]
        assert np.allclose(shared.where((F.col("p") == p) & (F.col("d") == d)).first()["w"], own)
    params, fitted = fleet.refit(df, HOUR, "ARIMA", 24, 6, fleet.tune(df, HOUR, "ARIMA", 24, 6, space, n_trials=5))
    best = min(trials, key=lambda r: r.cv_rmse)
    assert {k: str(v) for k, v in params.items()} == best.params and len(fitted.first()["w"]) == params["p"] + 1


def test_tree_trials_are_scored_apart(spark):
    space = {"n_estimators": {"type": "categorical", "choices": [2, 10]}, "max_depth": {"type": "categorical", "choices": [3, 99]}}
    trials = fleet.tune(frame(spark, stride_series(500)), HOUR, "GradientBoosting", 24, 3, space, n_trials=6, seed=1).collect()
    by = {(r.params["n_estimators"], r.params["max_depth"]): r.cv_rmse for r in trials}
    assert by["2", "3"] > by["10", "3"] and all(v is None for k, v in by.items() if k[1] == "99")


def test_bands_cover_about_their_nominal_share(spark):
    df = frame(spark, stride_series(1500))
    out = fleet.backtest(df, HOUR, "NaiveSeasonal", 24, 24, stride=6, levels=[0.1, 0.9])
    r = out["intervals"].first()
    assert 0.65 < r["coverage"] < 0.92 and r["nominal_coverage"] == pytest.approx(0.8)
    assert out["coverage"].count() == 24


def test_band_metrics_at_the_extremes(spark):
    rows = [("a", 1, 10.0, 9.0, 10.0, 11.0), ("a", 1, 10.0, 9.5, 10.0, 10.5)]
    df = spark.createDataFrame(rows, "series_id string, h int, actual double, q0_1 double, q0_5 double, q0_9 double")
    levels = {"q0_1": 0.1, "q0_5": 0.5, "q0_9": 0.9}
    assert metrics.interval_metrics(df, levels).first()["coverage"] == 1.0
    off = df.withColumn("actual", F.lit(100.0))
    assert metrics.interval_metrics(off, levels).first()["coverage"] == 0.0


def test_levels():
    assert intervals.validate_levels(None) == [0.1, 0.5, 0.9]
    assert intervals.validate_levels([0.9, 0.1, 0.1]) == [0.1, 0.5, 0.9]
    for bad in ([], [0.0], [1.0], ["x"]):
        with pytest.raises(ValueError):
            intervals.validate_levels(bad)


def test_metrics_of_odd_inputs(spark):
    rows = [("zero", 0.0, 1.0), ("zero", 0.0, 2.0), ("flat", 5.0, 5.0), ("flat", 5.0, 6.0)]
    m = {r["series_id"]: r for r in metrics.point_metrics(spark.createDataFrame(rows, "series_id string, actual double, yhat double")).collect()}
    assert m["zero"]["mape"] == float("inf") and m["zero"]["cv_rmse"] == float("inf") and m["zero"]["r_squared"] == 0
    assert m["flat"]["r_squared"] == 0 and m["flat"]["mape"] == pytest.approx(10)


def test_one_bad_series_does_not_stop_a_fleet(spark):
    good = stride_series(400, name="good")
    bad = stride_series(40, name="bad")
    out = fleet.train_fleet(frame(spark, pd.concat([good, bad])), HOUR, "LinearRegression", 24, 6)
    assert out["summary"].first().asDict() == {"total": 2, "succeeded": 1, "failed": 1}
    assert out["failures"].first()["series_id"] == "bad"
    run = out["runs"].first()
    assert run["cv_rmse"] > 0 and run["train_cv_rmse"] > 0 and run["energy_kwh"] >= 0
    last = fleet.train_fleet(frame(spark, good), HOUR, "NaiveMean", 24, 6, steps="last")
    assert {r["h"] for r in last["scored"].select("h").distinct().collect()} == {6}


def test_forward_forecast_starts_after_the_last_known_load(spark):
    pdf = stride_series(600)
    pdf.loc[pdf.index >= 580, "load"] = np.nan
    for model in ("NaiveSeasonal", "NaiveMean", "NaiveMovingAverage", "ARIMA", "LinearRegression"):
        f = pandas_of(fleet.forward_forecast(frame(spark, pdf), HOUR, 12, model), "h")
        assert f["ts"].tolist() == pdf["ts"][580:592].tolist() and f["yhat"].notna().all(), model
        actual = stride_series(600)["load"][580:592].to_numpy()
        assert np.abs(f["yhat"] - actual).mean() < 400, model
    with pytest.raises(ValueError):
        fleet.forward_forecast(frame(spark, pdf), HOUR, 48, trained_horizon=24)


def test_search_is_seeded_and_keeps_failed_trials(spark):
    space = {"a": {"type": "int", "low": 1, "high": 9}, "b": {"type": "float", "low": 0.01, "high": 1.0, "log": True}, "c": {"type": "categorical", "choices": ["x", "y"]}}

    def objective(p):
        if p["c"] == "y":
            raise ValueError("no")
        return p["a"] + p["b"]

    one = fleet.random_search(spark, objective, space, 8, seed=3).drop("duration_s").orderBy("trial").collect()
    two = fleet.random_search(spark, objective, space, 8, seed=3).drop("duration_s").orderBy("trial").collect()
    assert one == two and any(r["cv_rmse"] is None for r in one)
    with pytest.raises(RuntimeError):  # no fault of a setting
        fleet.random_search(spark, lambda p: (_ for _ in ()).throw(RuntimeError("lost")), space, 2)
    best = fleet.best_trial(spark.createDataFrame(one)).first()
    assert best["cv_rmse"] == min(r["cv_rmse"] for r in one if r["cv_rmse"] is not None)


def test_tune_finds_the_daily_period(spark):
    space = {"period": {"type": "categorical", "choices": [7, 24]}}
    trials = fleet.tune(frame(spark, stride_series(600)), HOUR, "NaiveSeasonal", 24, 24, space, n_trials=4, seed=1)
    assert fleet.best_trial(trials).first()["params"]["period"] == "24"

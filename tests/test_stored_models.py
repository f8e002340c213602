"""Covariates in fits, stored runs, job tables."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import batch, fleet, metrics
from gridcast.operators.covariates import merge_by_block, merge_covariates
from gridcast.sources.models import ModelStore
from tests.helpers import frame, pandas_of, stride_series

HOUR = 3600


def driven(n=700, seed=5, names=("a", "b")):
    """Load that a covariate of the same hour drives."""
    rng, out = np.random.default_rng(seed), []
    for k, name in enumerate(names):
        t = pd.date_range("2024-01-01", periods=n, freq="h")
        x = rng.normal(0, 10, n).round(6)
        out.append(pd.DataFrame({"series_id": name, "ts": t, "load": 100 + 20 * k + 3 * x + rng.normal(0, 0.5, n), "temp": x}))
    return pd.concat(out, ignore_index=True)


def driven_frame(spark, pdf):
    return frame(spark, pdf, "series_id string, ts timestamp_ntz, load double, temp double")


@pytest.mark.parametrize("model", ["LinearRegression", "ARIMA"])
def test_a_known_ahead_covariate_explains_the_load(spark, model):
    df = driven_frame(spark, driven())
    kw = {"params": {"p": 1, "d": 0}} if model == "ARIMA" else {}
    with_cov = fleet.backtest(df, HOUR, model, 4, 3, future=["temp"], **kw)["metrics"].collect()
    without = fleet.backtest(df.drop("temp"), HOUR, model, 4, 3, **kw)["metrics"].collect()
    assert all(r["r_squared"] > 0.95 for r in with_cov) and all(r["r_squared"] < 0.5 for r in without)


def test_trees_take_covariates(spark):
    grid = fleet.prepare(driven_frame(spark, driven(600, names=("a",))), HOUR, ["temp"])
    f = fleet.forecast(grid, HOUR, "GradientBoosting", 2, 2, start_fraction=0.6, future=["temp"], past=["temp"], params={"n_estimators": 30, "learning_rate": 0.3})
    assert metrics.point_metrics(metrics.score(f, grid)).first()["r_squared"] > 0.8


def test_shared_covariates_by_block(spark, tiny_blocks):
    load = frame(spark, stride_series(100)).select("series_id", "ts", "load")
    cov = load.where("load > 900").groupBy("ts").agg(F.min("load").alias("c"))
    want, got = pandas_of(merge_covariates(load, cov, ["c"])), pandas_of(merge_by_block(load, cov, HOUR, ["c"]).drop("_blk"))
    pd.testing.assert_frame_equal(want[got.columns.tolist()], got)


def test_covariate_holes_are_carried_forward(spark):
    pdf = driven(60, names=("a",))
    pdf.loc[[0, 1, 10, 11, 12], "temp"] = np.nan
    grid = pandas_of(fleet.prepare(driven_frame(spark, pdf), HOUR, ["temp"]))
    assert np.allclose(grid["temp"], pdf["temp"].ffill().bfill())


def test_gaps_longer_than_the_limit_stay_open_and_unscored(spark):
    pdf = stride_series(400)
    df = frame(spark, pdf.drop(index=range(300, 340)))
    limited = fleet.prepare(df, HOUR, max_gap=6 * HOUR)
    assert limited.where("load is null").count() == 40
    all_steps = fleet.backtest(df, HOUR, "NaiveSeasonal", 24, 24)["metrics"].first()["n"]
    real = fleet.backtest(df, HOUR, "NaiveSeasonal", 24, 24, real_only=True)["metrics"].first()["n"]
    assert real == all_steps - 40


def test_forward_covariates_and_series_that_lack_them(spark, tmp_path):
    pdf = driven(500)
    last = datetime(2024, 1, 1) + pd.Timedelta(hours=489)
    actual = pdf[pdf["ts"] > last]
    ahead = pdf.copy()
    ahead.loc[ahead["ts"] > last, "load"] = np.nan
    ahead.loc[(ahead["ts"] > last) & (ahead["series_id"] == "b"), "temp"] = np.nan
    df = driven_frame(spark, ahead)
    store = ModelStore(spark, str(tmp_path / "store"))
    store.save(fleet.train_fleet(df.where("load is not null"), HOUR, "LinearRegression", 4, 6, future=["temp"], calendar_static=False))
    out = batch.forecast_stored(df, HOUR, store)
    f = pandas_of(out["forecasts"], "h")
    assert set(f["series_id"]) == {"a"} and len(f) == 6 and f["model_id"].notna().all()
    want = actual[actual["series_id"] == "a"]["load"].to_numpy()[:6]
    assert np.abs(f["yhat"].to_numpy() - want).max() < 3
    assert [(r["series_id"], r["error"]) for r in out["failures"].collect()] == [("b", "6 of 6 future rows missing")]


@pytest.mark.parametrize("model,params", [("GradientBoosting", {"n_estimators": 5, "max_depth": 3}), ("NaiveMean", None)])
def test_stored_runs_forecast_as_fresh_ones(spark, tmp_path, model, params):
    df = frame(spark, stride_series(500))
    store = ModelStore(spark, str(tmp_path / "store"))
    trained = fleet.train_fleet(df, HOUR, model, 24, 4, params=params)
    fit_id = store.save(trained)
    runs = store.runs()
    ids = [r["model_id"] for r in runs.collect()]
    assert runs.count() == 1 and runs.first()["fit_id"] == fit_id
    got = pandas_of(batch.forecast_stored(df, HOUR, store, ids)["forecasts"], "h")
    want = pandas_of(fleet.forward_forecast(df, HOUR, 4, model, 24, params=params, fitted=trained["fitted"]), "h")
    assert np.allclose(got["yhat"], want["yhat"])
    assert batch.forecast_stored(df, HOUR, store, spark.createDataFrame([("nobody",)], "model_id string"))["forecasts"] is None
    blocks = batch.evaluate_stored(df, HOUR, store, ids)
    assert blocks["metrics"].first()["model_id"] == ids[0]
    wrong = batch.forecast_stored(df, 1800, store, ids)
    assert wrong["forecasts"] is None and "trained at step h" in wrong["failures"].first()["error"]
    store.registry.delete(ids[0])
    assert store.runs().count() == 0


def test_bands_follow_later_residuals(spark, tmp_path):
    df = frame(spark, stride_series(800))
    store = ModelStore(spark, str(tmp_path / "store"))
    trained = fleet.train_fleet(df, HOUR, "NaiveSeasonal", 24, 6)
    fit_id = store.save(trained)
    seen = pandas_of(trained["scored"].where("role = 'validation'"), "h", "origin_ts")
    later = trained["scored"].withColumn("actual", F.col("actual") + 1000).where("role = 'validation'")
    for extra in (None, later):
        if extra is not None:
            store.add_residuals(fit_id, extra)
            seen = pd.concat([seen, pandas_of(extra, "h", "origin_ts")])
        q = pandas_of(store.residual_quantiles(fit_id, [0.1, 0.9]), "h")
        low, high = q["_rq0_1"].to_numpy(), q["_rq0_9"].to_numpy()
        for h, lo, hi in zip(q["h"], low, high):
            e = np.sort((seen["actual"] - seen["yhat"])[seen["h"] == h].to_numpy())
            assert lo == e[int(np.ceil(0.1 * len(e))) - 1] and hi == e[int(np.ceil(0.9 * len(e))) - 1]
    banded = batch.forecast_stored(df, HOUR, store, levels=[0.1, 0.9])["forecasts"]
    assert banded.where("q0_1 <= yhat and yhat <= q0_9").count() == 6


def test_jobs_stop_at_the_first_error_or_go_on(spark, tmp_path):
    df = frame(spark, pd.concat([stride_series(300, name="a"), stride_series(300, name="b"), stride_series(20, name="short")]))
    jobs = spark.createDataFrame([("a", "NaiveSeasonal", 24, 24, None), ("b", "ARIMA", 24, 6, '{"p": 2, "d": 0}'), ("short", "NaiveMean", 24, 6, None)], batch.JOBS)
    store = ModelStore(spark, str(tmp_path / "store"))
    out = batch.train_jobs(df, HOUR, jobs, store)
    assert {(r["series_id"], r["horizon"]) for r in store.runs().collect()} == {("a", 24), ("b", 6)}
    assert [tuple(r)[:4] for r in out["failures"].collect()] == [("short", "NaiveMean", 24, 6)] and out["summary"].first()["failed"] == 1
    assert batch.forecast_stored(df, HOUR, store)["forecasts"].groupBy("series_id").count().count() == 2
    with pytest.raises(batch.JobsStopped) as stopped:
        batch.train_jobs(df, HOUR, jobs, stop_at_first_error=True)
    assert stopped.value.failures[0][0] == "short" and "needed" in str(stopped.value)
    with pytest.raises(batch.JobsStopped):
        batch.train_jobs(df, HOUR, spark.createDataFrame([("a", "Nope", 24, 24, None)], batch.JOBS), stop_at_first_error=True)

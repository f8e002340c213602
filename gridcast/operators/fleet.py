"""Training, backtesting, forecasting and searching over all series at once."""

from __future__ import annotations

import math
import random
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import LOAD, SERIES, TS, attach
from gridcast.functions.time import STEP_SECONDS, add_seconds, calendar, epoch, steps_per_day
from gridcast.operators import baselines, intervals, metrics
from gridcast.operators.checks import SPARE_ROWS
from gridcast.operators.covariates import fill_covariates
from gridcast.operators.grid import interpolate, regular_grid
from gridcast.operators.learners import fit_linear, predict_linear
from gridcast.operators.origins import mark_origins, over_horizon, supervised
from gridcast.operators.splits import seasonal_split, sequential_split
from gridcast.operators.trees import fit_boosted, predict_boosted, settings
from gridcast.session import settle
from gridcast.sources.registry import model_id

# Assumed power draw in watts.
WATTS = {
    "NaiveMean": 15, "NaiveSeasonal": 15, "NaiveMovingAverage": 15,
    "LinearRegression": 65, "ARIMA": 65, "GradientBoosting": 100,
}
DEFAULT_WATTS = 65
# Default search spaces.
SEARCH_SPACES = {
    "GradientBoosting": {
        "n_estimators": {"type": "int", "low": 30, "high": 300},
        "max_depth": {"type": "int", "low": 3, "high": 8},
        "learning_rate": {"type": "float", "low": 0.01, "high": 0.3, "log": True},
        "subsample": {"type": "float", "low": 0.6, "high": 1.0},
        "colsample_bytree": {"type": "float", "low": 0.6, "high": 1.0},
    },
    "ARIMA": {
        "p": {"type": "int", "low": 1, "high": 6},
        "d": {"type": "categorical", "choices": [0, 1]},
    },
    "LinearRegression": {}, "NaiveMean": {}, "NaiveSeasonal": {}, "NaiveMovingAverage": {},
}
FITTED_MODELS = ("LinearRegression", "GradientBoosting", "ARIMA")
SINGLE_SERIES_MODELS = ("NaiveMean", "NaiveSeasonal", "NaiveMovingAverage", "ARIMA")


def energy_kwh(model: str, seconds: float) -> float:
    """Assumed energy of a fit: watts times seconds."""
    return WATTS.get(model, DEFAULT_WATTS) * seconds / 3.6e6


def prepare(readings: DataFrame, step_seconds: int, covariates: Sequence[str] = (), max_gap: int | None = None) -> DataFrame:
    """Readings on a regular grid without holes (one shuffle of the rows).

    Holes in the load are interpolated, with ``max_gap`` (seconds) only shorter ones; ``interpolated`` marks what was filled. Covariates carry
    their last known value forward. Every forecaster reads the grid several times (origins, sources, actual
    values), so it is settled here.
    """
    columns = [SERIES, TS, LOAD, *dict.fromkeys(covariates)]
    grid = interpolate(regular_grid(readings.select(*columns) if covariates else readings, step_seconds), step_seconds, max_gap_seconds=max_gap, head=True)
    return settle(fill_covariates(grid, columns[3:]).drop("was_missing") if covariates else grid)


def split_failures(readings: DataFrame, lookback: int, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Series long enough to train, and ``failures(series_id, error)``.

    Every other series goes on: one bad meter never stops a fleet.
    """
    need = lookback + horizon + SPARE_ROWS
    stats = readings.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_rows"), F.count(LOAD).alias("n_known"))
    error = (
        F.when(F.col("n_rows") < need, F.format_string("%d rows, %d needed", "n_rows", F.lit(need)))
        .when(F.col("n_known") < 0.9 * F.col("n_rows"), F.lit("target coverage below 90 %"))
    )
    checked = stats.withColumn("error", error)
    good = attach(readings, checked.where("error is null").select(SERIES), [SERIES])
    return good, checked.where("error is not null").select(SERIES, "error")


def _windows(
    grid: DataFrame, step_seconds: int, lookback: int, horizon: int, train: Column | None, calendar_static: bool,
    past: Sequence[str] = (), future: Sequence[str] = (), **kwargs,
) -> DataFrame:
    """Supervised rows of a fitted model. ``fit_ok`` rows lie wholly inside what ``train`` marks, by default
    the rows before the first origin of each series."""
    marked = mark_origins(grid, step_seconds, lookback, horizon, keep_rel=True, **kwargs)
    static = []
    if calendar_static:
        cal = calendar(TS)
        static = [c for c in cal if c.endswith(("_sin", "_cos"))]
        marked = marked.withColumns({c: cal[c] for c in static})
    if "role" not in marked.columns:
        early = F.col("rel") < 0 if train is None else train
        marked = marked.withColumn("role", F.when(early, "training").otherwise("validation"))
    return supervised(marked.drop("rel"), step_seconds, lookback, horizon, past=past, future=future, static=static, keep_open=True)


def _fit_rows(rows: DataFrame, model: str, horizon: int, params: dict) -> DataFrame:
    if model == "LinearRegression":
        return fit_linear(rows.where("fit_ok").select(SERIES, "x", "y"), [SERIES], ridge=params.get("ridge", 0.0))
    return fit_boosted(rows.where("fit_ok"), horizon, [params])


def fit(
    grid: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int,
    train: Column | None = None, params: dict | None = None, calendar_static: bool = True, past: Sequence[str] = (), future: Sequence[str] = (),
) -> DataFrame | None:
    """What a model learns from the rows that ``train`` marks (default: all rows of ``grid``).

    Linear models and trees take the lookback of the ``past`` covariates and the ``future`` ones over the horizon, AR models the latter.

    A settled table of coefficients ``(series_id, h, w)`` or of trees (:func:`gridcast.operators.trees.fit_boosted`), or None for a
    model without a fit. Both are plain tables: write it, read it, and give it to :func:`forecast` as ``fitted``.
    """
    params, train = dict(params or {}), F.lit(True) if train is None else train
    if model not in FITTED_MODELS:
        return None
    if model == "ARIMA":
        return settle(baselines.fit_autoregression(grid, step_seconds, params.get("p", 1), params.get("d", 1), future, train))
    return settle(_fit_rows(_windows(grid, step_seconds, lookback, horizon, train, calendar_static, past, future), model, horizon, params))


def forecast(
    grid: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int,
    train: Column | None = None, params: dict | None = None, calendar_static: bool = True, fitted: DataFrame | None = None,
    past: Sequence[str] = (), future: Sequence[str] = (), **kwargs,
) -> DataFrame:
    """Forecast rows of every rolling origin for one kind of model.

    ``fitted`` is the result of :func:`fit`. Without it the model is fitted here on the rows that ``train`` marks,
    by default those before the first origin of each series, so no scored value is part of a fit.
    Nothing is refitted while rolling. ``past`` and ``future`` name covariates of ``grid`` (see :func:`fit`); naive models use none.
    """
    params = dict(params or {})
    if model == "NaiveSeasonal":
        period = int(params.get("period") or steps_per_day(step_seconds))
        return baselines.rolling_seasonal(grid, step_seconds, max(lookback, period), horizon, period=period, **kwargs)
    if model == "NaiveMean":
        return baselines.expanding_mean(grid, step_seconds, lookback, horizon, **kwargs)
    if model == "NaiveMovingAverage":
        return baselines.moving_average(grid, step_seconds, lookback, horizon, **kwargs)
    if model == "ARIMA":
        return baselines.autoregression(
            grid, step_seconds, horizon, params.get("p", 1), params.get("d", 1), future, train, lookback=lookback, coef=fitted, **kwargs
        )
    if model not in FITTED_MODELS:
        raise ValueError(f"unknown model {model!r}")
    rows = _windows(grid, step_seconds, lookback, horizon, train, calendar_static, past, future, **kwargs)
    if fitted is None:
        fitted = _fit_rows(rows, model, horizon, params)
    origins = rows.where("is_origin")
    if model == "LinearRegression":
        return predict_linear(origins, fitted, step_seconds, horizon)
    return predict_boosted(fitted.where(F.col("h") <= horizon), origins, step_seconds)


def backtest(
    readings: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int,
    stride: int | None = None, levels: Sequence[float] | None = None, peaks: DataFrame | None = None,
    max_gap: int | None = None, real_only: bool = False, **kwargs,
) -> dict[str, DataFrame]:
    """Roll a model over history and score it in every way.

    With ``real_only`` steps without a reading of their own are forecast but not scored.

    One settled table of scored rows feeds all blocks. Bands come from the residuals of the first half of the
    windows and are scored on the rest.
    """
    grid = prepare(readings, step_seconds, [*kwargs.get("past", ()), *kwargs.get("future", ())], max_gap)
    f = forecast(grid, step_seconds, model, lookback, horizon, stride=stride, **kwargs)
    scored = settle(metrics.score(f.drop("actual"), grid.where("not interpolated")) if real_only else metrics.score(f, grid))
    flat = metrics.flatten(scored)
    days = metrics.peak_days(flat, peaks)
    out = {
        "forecasts": scored,
        "metrics": metrics.point_metrics(scored, [SERIES, "model"]),
        "windows": metrics.window_metrics(scored),
        "horizon": metrics.horizon_metrics(scored),
        "residuals": metrics.residual_diagnostics(flat, step_seconds),
        "peak_days": days,
        "peaks": metrics.peak_summary(days),
        "summary": metrics.backtest_summary(scored, stride or horizon),
        "by_hour": metrics.error_by_hour(flat),
        "by_weekday": metrics.error_by_weekday(flat),
    }
    if levels is not None:
        calibration, test = halves(scored)
        banded = intervals.add_bands(test, intervals.residual_quantiles(calibration, levels), levels)
        names = {intervals.level_column(q): q for q in intervals.validate_levels(levels)}
        lo, hi = min(names, key=names.get), max(names, key=names.get)
        out["intervals"] = metrics.interval_metrics(banded, names)
        out["coverage"] = metrics.horizon_coverage(banded, lo, hi)
        out["bands"] = banded
    return out


def halves(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored rows of the earlier and later half of each series' time range."""
    e = scored.groupBy(SERIES).agg(F.min("origin_ts").alias("_a"), F.max("origin_ts").alias("_b"))
    d = attach(scored, e, [SERIES])
    early = F.col("origin_ts") <= F.col("_a") + (F.col("_b") - F.col("_a")) / 2
    return d.where(early).drop("_a", "_b"), d.where(~early).drop("_a", "_b")


def evaluate(readings: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int, **kwargs) -> dict[str, DataFrame]:
    """Held-out evaluation: the backtest blocks at stride = horizon from the
    first possible origin.

    A fitted model comes as ``fitted`` (see :func:`fit`): held-out readings are only forecast, never fitted.
    """
    if model in FITTED_MODELS and kwargs.get("fitted") is None:
        raise ValueError(f"{model} must be fitted on other readings first")
    return backtest(readings, step_seconds, model, lookback, horizon, stride=horizon, start_fraction=0.0, **kwargs)


def stride_sweep(readings: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int, strides: Sequence[int] = (1, 6, 12, 24), **kwargs) -> DataFrame:
    """Metrics of the same backtest at several strides.

    The finest stride is forecast once where it divides the others; each
    window then belongs to every stride its position is a multiple of.
    """
    grid = prepare(readings, step_seconds)
    finest = math.gcd(*strides)
    f = forecast(grid, step_seconds, model, lookback, horizon, stride=finest, **kwargs)
    marked = mark_origins(grid, step_seconds, lookback, horizon, stride=finest, **{k: v for k, v in kwargs.items() if k in ("start_fraction", "starts")})
    first = marked.where("is_origin").groupBy(SERIES).agg(F.min(TS).alias("_o0"))
    scored = attach(metrics.score(f, grid), first, [SERIES])
    rel = ((epoch("origin_ts") - epoch("_o0")) / step_seconds).cast("long")
    member = F.filter(F.array(*[F.lit(s) for s in strides]), lambda s: rel % s == 0)
    return metrics.point_metrics(scored.withColumn("stride", F.explode(member)), [SERIES, "model", "stride"])


def train_fleet(
    readings: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int,
    building: Column | None = None, validation: float = 0.2, params: dict | None = None, steps: str = "all",
    past: Sequence[str] = (), future: Sequence[str] = (), calendar_static: bool = True, max_gap: int | None = None,
) -> dict[str, DataFrame]:
    """Fit every series, score both parts and describe the runs.

    ``steps`` scores all steps of each window or only the last one, the same
    on both parts. Returns ``runs`` (ready for the registry), ``failures``,
    ``scored``, ``summary`` and ``fitted``, which :func:`evaluate` and :func:`forward_forecast` take.
    """
    good, failures = split_failures(readings, lookback, horizon)
    grid = prepare(good, step_seconds, [*past, *future], max_gap)
    rule = sequential_split if model in SINGLE_SERIES_MODELS else seasonal_split
    split = settle(rule(grid, step_seconds, validation).drop("idx", "n_rows"))
    began = time.monotonic()
    taken = {"calendar_static": calendar_static, "past": past, "future": future}
    fitted = fit(split, step_seconds, model, lookback, horizon, F.col("role") == "training", params, **taken)
    seconds = time.monotonic() - began  # the fit alone
    f = forecast(split, step_seconds, model, lookback, horizon, params=params, fitted=fitted, start_fraction=0.0, **taken)
    roles = split.select(SERIES, F.col(TS).alias("origin_ts"), "role")
    scored = metrics.score(f, split).join(roles, [SERIES, "origin_ts"])
    if steps == "last":
        scored = scored.where(F.col("h") == horizon)
    m = metrics.point_metrics(scored, [SERIES, "role"])
    wide = m.groupBy(SERIES).agg(
        F.max(F.when(F.col("role") == "training", F.col("cv_rmse"))).alias("train_cv_rmse"),
        F.max(F.when(F.col("role") == "validation", F.col("cv_rmse"))).alias("cv_rmse"),
    )
    facts = split.groupBy(SERIES).agg(
        F.min(TS).alias("train_start"), F.max(TS).alias("train_end"), F.count(F.lit(1)).alias("n_rows")
    )
    created, fit_id = F.localtimestamp(), uuid.uuid4().hex[:8]
    base = building if building is not None else F.col(SERIES)
    label = next((k for k, s in STEP_SECONDS.items() if s == step_seconds), f"{step_seconds}s")
    runs = facts.join(wide, SERIES, "left").select(
        model_id(base, F.lit(model), created, F.concat_ws("_", F.lit(fit_id), SERIES)).alias("model_id"),
        F.lit(fit_id).alias("fit_id"), SERIES, base.alias("building"), F.lit(model).alias("model_type"), created.alias("created_at"),
        F.lit(label).alias("frequency"), F.lit(lookback).alias("lookback"), F.lit(horizon).alias("horizon"),
        F.lit(validation).alias("validation_split"), F.lit(LOAD).alias("target"),
        F.array(*[F.lit(c) for c in past]).cast("array<string>").alias("past_covariates"),
        F.array(*[F.lit(c) for c in future]).cast("array<string>").alias("future_covariates"), F.lit(calendar_static).alias("calendar_static"),
        "train_start", "train_end", "n_rows", "train_cv_rmse", "cv_rmse",
        F.lit(seconds).alias("runtime_s"), F.lit(energy_kwh(model, seconds)).alias("energy_kwh"),
        (F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv]) if params
         else F.create_map().cast("map<string,string>")).alias("params"),
    )
    return {"runs": runs, "failures": failures, "scored": scored, "summary": summarise(runs, failures), "fitted": fitted, "fit_id": fit_id}


def summarise(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Totals of a batch; failures keep their own table."""
    rows = runs.select(F.lit(1).alias("ok"), F.lit(0).alias("bad")).unionByName(
        failures.select(F.lit(0).alias("ok"), F.lit(1).alias("bad"))
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.sum("ok").alias("succeeded"), F.sum("bad").alias("failed")
    )


def forward_origins(readings: DataFrame, step_seconds: int) -> DataFrame:
    """The step after the last known load of every series."""
    return readings.where(F.col(LOAD).isNotNull()).groupBy(SERIES).agg(
        add_seconds(F.max(TS), step_seconds).alias("origin_ts")
    )


def forward_forecast(
    readings: DataFrame, step_seconds: int, horizon: int, model: str = "NaiveSeasonal",
    lookback: int = 24, trained_horizon: int | None = None, params: dict | None = None, fitted: DataFrame | None = None,
    past: Sequence[str] = (), future: Sequence[str] = (), calendar_static: bool = True,
) -> DataFrame:
    """Forecast past the last known load of every series.

    The future steps are appended as rows without load, so a forward forecast
    is the rolling forecast of one extra origin. ``fitted`` is a stored fit;
    without it the model is fitted on all known rows. ``future`` covariates come from the rows ahead in ``readings``; series whose rows
    ahead lack one of them get no forecast, see :func:`missing_future`.
    """
    if trained_horizon is not None and horizon > trained_horizon:
        raise ValueError(f"horizon {horizon} exceeds the trained {trained_horizon}")
    origins = forward_origins(readings, step_seconds)
    context = attach(readings, origins, [SERIES]).where(F.col(TS) < F.col("origin_ts")).drop("origin_ts")
    covariates = list(dict.fromkeys([*past, *future]))
    grid = prepare(context, step_seconds, covariates)
    if model == "NaiveSeasonal":
        return baselines.seasonal_naive(grid, origins, step_seconds, horizon, (params or {}).get("period"))
    starts = readings_length(grid)
    ahead = over_horizon(origins, step_seconds, horizon).select(SERIES, TS, F.lit(None).cast("double").alias(LOAD), F.lit(False).alias("_known"))
    if future:
        ahead = ahead.join(readings.groupBy(SERIES, TS).agg(*[F.min(c).alias(c) for c in future]), [SERIES, TS], "left")
        starts = starts.join(missing_future(readings, step_seconds, horizon, future).select(SERIES), SERIES, "left_anti")
    ahead = ahead.withColumns({c: F.lit(None).cast(grid.schema[c].dataType) for c in past if c not in future})
    columns = [SERIES, TS, LOAD, *covariates]
    rows = grid.select(*columns, F.lit(True).alias("_known")).unionByName(ahead.select(*columns, "_known"))
    return forecast(
        rows, step_seconds, model, lookback, horizon, train=F.col("_known"), params=params, starts=starts, fitted=fitted,
        past=past, future=future, calendar_static=calendar_static,
    )


def readings_length(grid: DataFrame) -> DataFrame:
    """``start_idx`` right after the known rows of each series."""
    return grid.groupBy(SERIES).agg(F.count(F.lit(1)).alias("start_idx")).withColumn("error", F.lit(None).cast("string"))


def missing_future(readings: DataFrame, step_seconds: int, horizon: int, future: Sequence[str]) -> DataFrame:
    """Series whose known-ahead covariates do not cover the horizon."""
    want = over_horizon(forward_origins(readings, step_seconds), step_seconds, horizon).select(SERIES, TS)
    have = readings.groupBy(SERIES, TS).agg(*[F.min(c).alias(c) for c in future])
    d = want.join(have, [SERIES, TS], "left")
    bad = F.lit(False)
    for c in future:
        bad = bad | F.col(c).isNull()
    return d.groupBy(SERIES).agg(F.count_if(bad).alias("n_missing")).where("n_missing > 0").withColumn(
        "error", F.format_string("%d of %d future rows missing", "n_missing", F.lit(horizon))
    )


# -- search -----------------------------------------------------------------------------------


# How a value of each kind is drawn from its specification.
DRAWS: dict[str, Callable[[random.Random, dict], object]] = {
    "categorical": lambda rng, s: rng.choice(list(s["choices"])),
    "int": lambda rng, s: rng.randint(s["low"], s["high"]),
    "float": lambda rng, s: rng.uniform(s["low"], s["high"]),
    "log": lambda rng, s: math.exp(rng.uniform(math.log(s["low"]), math.log(s["high"]))),
}


def drawn(space: dict[str, dict], n_trials: int, seed: int) -> list[dict]:
    """Seeded draws from a typed space: categorical, int, float, and float on a log scale (``log``)."""
    rng = random.Random(seed)
    kinds = {name: "log" if s.get("log") else s.get("type", "float") for name, s in space.items()}
    return [{name: DRAWS[kinds[name]](rng, s) for name, s in space.items()} for _ in range(n_trials)]


TRIALS = "trial int, params map<string,string>, cv_rmse double, duration_s double"
# What a setting may be wrong by; anything else, a lost executor too, is no trial's fault and ends the search.
FAULTS = (ValueError, ArithmeticError, KeyError, TypeError)


def random_search(
    spark, objective: Callable[[dict], float], space: dict[str, dict], n_trials: int = 20, seed: int = 42, parallelism: int = 4
) -> DataFrame:
    """Seeded random search; trials run as concurrent Spark jobs.

    ``objective`` returns the validation CV-RMSE of one setting. A trial whose setting is refused or cannot
    be computed (``FAULTS``) is kept with a NULL score. Returns the ``trials`` table.
    """
    def run(item):
        number, params = item
        began = time.monotonic()
        try:
            value = float(objective(params))
            value = value if math.isfinite(value) else None
        except FAULTS:
            value = None
        return number, {k: str(v) for k, v in params.items()}, value, time.monotonic() - began

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, enumerate(drawn(space, n_trials, seed))))
    return spark.createDataFrame(rows, TRIALS)


def _accepted(model: str, params: dict) -> bool:
    try:
        if model == "GradientBoosting":
            settings(params)
        elif model == "ARIMA" and (int(params.get("p", 1)) < 1 or not 0 <= int(params.get("d", 1)) <= 2):
            return False
    except FAULTS:
        return False
    return True


def _forecasts_by_trial(split: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int, draws: dict[int, dict]) -> DataFrame:
    """Forecasts with a ``trial`` column of all settings. The trials share the passes over the rows.

    Trees of all trials grow together and are applied in one scan; AR models of all orders are solved from one matrix per
    series and difference, and orders drawn twice are forecast once.
    """
    train = F.col("role") == "training"
    if model == "GradientBoosting":
        rows = _windows(split, step_seconds, lookback, horizon, train, True, start_fraction=0.0)
        numbers = list(draws)
        trees = fit_boosted(rows.where("fit_ok"), horizon, [draws[t] for t in numbers])
        found = predict_boosted(trees, rows.where("is_origin"), step_seconds, by_trial=True)
        number = F.element_at(F.array(*[F.lit(t) for t in numbers]), F.col("trial") + 1)
        return found.withColumn("trial", number)
    orders: dict[tuple[int, int], list[int]] = {}
    for t, p in draws.items():
        orders.setdefault((int(p.get("p", 1)), int(p.get("d", 1))), []).append(t)
    coef = settle(baselines.fit_autoregressions(split, step_seconds, list(orders), train))
    found = None
    for (p, d), numbers in orders.items():
        own = coef.where((F.col("p") == p) & (F.col("d") == d)).select(SERIES, "h", "w")
        f = baselines.autoregression(split, step_seconds, horizon, p, d, lookback=lookback, coef=own, start_fraction=0.0)
        f = f.withColumn("trial", F.explode(F.array(*[F.lit(t) for t in numbers])))
        found = f if found is None else found.unionByName(f)
    return found


def tune(
    readings: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int,
    space: dict | None = None, n_trials: int = 20, seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Search a model's space for the lowest validation CV-RMSE over all series: the ``trials``.

    Fits see training rows only. Trials of trees and AR models share their passes (``duration_s`` is then an equal
    share); those of other models run as jobs of their own. :func:`refit` fits the best setting.
    """
    spark = readings.sparkSession
    space = SEARCH_SPACES[model] if space is None else space
    split, first = _search_split(readings, step_seconds, lookback, horizon)

    def scores(f: DataFrame, keys: list[str]) -> DataFrame:
        scored = attach(metrics.score(f, split), first, [SERIES]).where(F.col("origin_ts") >= F.col("_v0"))
        return metrics.point_metrics(scored, keys)

    if model not in ("GradientBoosting", "ARIMA"):
        def objective(params: dict) -> float:
            f = forecast(split, step_seconds, model, lookback, horizon, train=F.col("role") == "training", params=params, start_fraction=0.0)
            return scores(f, []).first()["cv_rmse"]

        return random_search(spark, objective, space, n_trials, seed, parallelism)
    draws = dict(enumerate(drawn(space, n_trials, seed)))
    began = time.monotonic()
    good = {t: p for t, p in draws.items() if _accepted(model, p)}
    value = {}
    if good:
        found = scores(_forecasts_by_trial(split, step_seconds, model, lookback, horizon, good), ["trial"])
        value = {r["trial"]: r["cv_rmse"] for r in found.select("trial", "cv_rmse").collect()}  # a row per trial
    share = (time.monotonic() - began) / max(len(draws), 1)
    finite = {t: v for t, v in value.items() if v is not None and math.isfinite(v)}
    return spark.createDataFrame([(t, {k: str(v) for k, v in p.items()}, finite.get(t), share) for t, p in draws.items()], TRIALS)


def _search_split(readings: DataFrame, step_seconds: int, lookback: int, horizon: int) -> tuple[DataFrame, DataFrame]:
    """The gridded series long enough to train, with ``role``, and when validation begins in each."""
    good, _ = split_failures(readings, lookback, horizon)
    split = settle(sequential_split(prepare(good, step_seconds), step_seconds).drop("idx", "n_rows"))
    return split, split.where("role = 'validation'").groupBy(SERIES).agg(F.min(TS).alias("_v0"))


def refit(readings: DataFrame, step_seconds: int, model: str, lookback: int, horizon: int, trials: DataFrame) -> tuple[dict, DataFrame | None]:
    """The best setting of ``trials``, typed as it was drawn, and its fit on the training rows alone.

    Without a scored trial the defaults are fitted.
    """
    best = best_trial(trials).select("params").collect()
    params = {k: typed(v) for k, v in best[0]["params"].items()} if best else {}
    split, _ = _search_split(readings, step_seconds, lookback, horizon)
    return params, fit(split, step_seconds, model, lookback, horizon, F.col("role") == "training", params)


def typed(text: str) -> int | float | bool | str:
    """A stored parameter as a number or truth value where it reads as one."""
    if text in ("True", "False", "true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.where("cv_rmse is not null").orderBy("cv_rmse", "trial").limit(1)

"""Forecasters without a fitted model, and autoregression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.blocks import (
    BLK, LOAD, SERIES, TS, attach, block_seconds, haloed, in_block, with_summary,
)
from gridcast.functions.time import add_seconds, steps_per_day
from gridcast.operators.grid import ensure_blocked
from gridcast.operators.learners import fit_linear, full_gram, solve_gram, sum_grams
from gridcast.operators.origins import mark_origins, over_horizon

FORECAST = (SERIES, "model", "origin_ts", "h", TS, "yhat")


def _finish(rows: DataFrame, model: str) -> DataFrame:
    return rows.withColumn("model", F.lit(model)).select(*FORECAST)


def seasonal_naive(grid: DataFrame, origins: DataFrame, step_seconds: int, horizon: int, period: int | None = None) -> DataFrame:
    """Repeat the last ``period`` (default: one day of) steps before the origin.

    The source time of every step is known, so this is one equi-join on
    ``(series_id, ts)``.
    """
    k = period or steps_per_day(step_seconds)
    f = over_horizon(origins, step_seconds, horizon).withColumn(
        "_src", add_seconds("origin_ts", (F.pmod(F.col("h") - 1, F.lit(k)) - k) * step_seconds)
    )
    source = grid.select(SERIES, F.col(TS).alias("_src"), F.col(LOAD).alias("yhat"))
    return _finish(f.join(source, [SERIES, "_src"]), "NaiveSeasonal")


def rolling_seasonal(
    grid: DataFrame, step_seconds: int, lookback: int, horizon: int,
    stride: int | None = None, period: int | None = None, **kwargs,
) -> DataFrame:
    """Seasonal naive at rolling origins, with ``actual``, without any join.

    Seen from the target row, the source lies a whole number of periods back,
    so it is a lag, and the windows a row belongs to follow from its position:
    one halo shuffle gives forecasts and actual values together.
    """
    k, stride = period or steps_per_day(step_seconds), stride or horizon
    d = mark_origins(grid, step_seconds, lookback, horizon, stride=stride, keep_rel=True, **kwargs)
    depth = -(-horizon // k)
    h = haloed(
        d.select(SERIES, TS, LOAD, "idx", "n_rows", "rel"),
        block_seconds(step_seconds, depth * k), before=depth * k * step_seconds,
    )
    w = Window.partitionBy(SERIES, BLK).orderBy(TS)
    sources = F.array(*[F.lag(LOAD, k * (m + 1)).over(w) for m in range(depth)])
    rel, n_left = F.col("rel"), F.col("n_rows") - F.col("idx")
    steps = F.filter(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda s: (rel - (s - 1) >= 0) & ((rel - (s - 1)) % stride == 0) & (n_left + (s - 1) >= horizon),
    )
    rows = h.withColumn("_s", sources).where("_own").withColumn("h", F.explode(steps))
    return rows.select(
        SERIES, F.lit("NaiveSeasonal").alias("model"),
        add_seconds(TS, -(F.col("h") - 1) * step_seconds).alias("origin_ts"), "h", TS,
        F.get("_s", F.floor((F.col("h") - 1) / k).cast("int")).alias("yhat"), F.col(LOAD).alias("actual"),
    )


def expanding_mean(grid: DataFrame, step_seconds: int, lookback: int, horizon: int, **kwargs) -> DataFrame:
    """Mean of all history before each origin, from block totals."""
    d = mark_origins(grid, step_seconds, lookback, horizon, **kwargs)
    d = with_summary(
        d,
        [F.sum(LOAD).alias("_s"), F.count(LOAD).alias("_c")],
        lambda before, after, whole: [
            F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_bs"),
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_bc"),
        ],
    )
    w = in_block().rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_bs") + F.coalesce(F.sum(LOAD).over(w), F.lit(0.0))
    count = F.col("_bc") + F.coalesce(F.count(LOAD).over(w), F.lit(0))
    o = d.withColumn("yhat", total / count).where("is_origin").select(SERIES, F.col(TS).alias("origin_ts"), "yhat")
    return _finish(over_horizon(o, step_seconds, horizon), "NaiveMean")


def origin_histories(
    grid: DataFrame, step_seconds: int, lookback: int, horizon: int,
    columns: Sequence[str] = (LOAD,), future: Sequence[str] = (), last: Sequence[str] = (),
    length: int | None = None, **kwargs,
) -> DataFrame:
    """Per origin, the last ``length`` (default: ``lookback``) values of each
    column as an array (``hist_<column>``), the coming ``horizon`` values of
    each future one (``fut_<column>``) and the value just before the origin of
    each ``last`` one (``last_<column>``)."""
    length = length or lookback
    d = mark_origins(grid, step_seconds, lookback, horizon, **kwargs).drop(BLK)
    h = haloed(
        d, block_seconds(step_seconds, max(length, horizon)),
        before=length * step_seconds, after=horizon * step_seconds if future else 0,
    )
    w = Window.partitionBy(SERIES, BLK).orderBy(TS)
    hist = {f"hist_{c}": F.collect_list(c).over(w.rowsBetween(-length, -1)) for c in columns}
    fut = {f"fut_{c}": F.collect_list(c).over(w.rowsBetween(0, horizon - 1)) for c in future}
    before = {f"last_{c}": F.lag(c).over(w) for c in last}
    d = h.withColumns({**hist, **fut, **before}).where(F.col("_own") & F.col("is_origin"))
    for c in hist:
        d = d.where(F.size(c) == length)
    for c in fut:
        d = d.where(F.size(c) == horizon)
    return d.select(SERIES, F.col(TS).alias("origin_ts"), *hist, *fut, *before)


def moving_average(grid: DataFrame, step_seconds: int, lookback: int, horizon: int, **kwargs) -> DataFrame:
    """Mean of the last ``lookback`` values, fed back step by step."""
    o = origin_histories(grid, step_seconds, lookback, horizon, **kwargs)
    start = F.struct(F.col(f"hist_{LOAD}").alias("buf"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, _h: Column) -> Column:
        mean = F.aggregate(acc["buf"], F.lit(0.0), lambda a, v: a + v) / lookback
        buf = F.concat(F.slice(acc["buf"], 2, lookback - 1), F.array(mean)) if lookback > 1 else F.array(mean)
        return F.struct(buf.alias("buf"), F.concat(acc["out"], F.array(mean)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["out"])
    rows = o.select(SERIES, "origin_ts", F.posexplode(path).alias("_i", "yhat")).withColumn("h", F.col("_i") + 1)
    rows = rows.withColumn(TS, add_seconds("origin_ts", F.col("_i") * step_seconds))
    return _finish(rows, "NaiveMovingAverage")


def difference(df: DataFrame, step_seconds: int, column: str, name: str) -> DataFrame:
    """First difference along the grid, across block edges."""
    d = with_summary(
        ensure_blocked(df, step_seconds),
        [F.max_by(column, TS).alias("_v")],
        lambda before, after, whole: [F.last("_v").over(before).alias("_carry")],
    )
    first = F.row_number().over(in_block()) == 1
    prev = F.when(first, F.col("_carry")).otherwise(F.lag(column).over(in_block()))
    return d.withColumn(name, F.col(column) - prev).drop("_carry")


def _differenced(grid: DataFrame, step_seconds: int, p: int, d: int) -> DataFrame:
    """The grid with the load's differences of order 0 to ``d`` as ``_z0`` to ``_z<d>``."""
    if not 0 <= d <= 2 or p < 1:
        raise ValueError("p >= 1 and d in 0..2")
    z = ensure_blocked(grid, step_seconds).withColumn("_z0", F.col(LOAD))
    for i in range(1, d + 1):
        z = difference(z, step_seconds, f"_z{i - 1}", f"_z{i}")
    return z


def lag_rows(grid: DataFrame, step_seconds: int, p: int, d: int, exog: Sequence[str] = (), train: Column | None = None) -> DataFrame:
    """``(series_id, x, y)``: the d-th difference against its last ``p`` values, nearest first, and the covariates, for rows that ``train`` marks."""
    z, name = _differenced(grid, step_seconds, p, d), f"_z{d}"
    w = Window.partitionBy(SERIES, BLK).orderBy(TS)
    base = z.select(SERIES, TS, name, *exog, (F.lit(True) if train is None else train).alias("_train"))
    h = haloed(base, block_seconds(step_seconds, p), before=p * step_seconds)
    lags = F.reverse(F.collect_list(name).over(w.rowsBetween(-p, -1)))
    return (
        h.withColumn("_l", lags)
        .where(F.col("_own") & F.col("_train") & (F.size("_l") == p) & F.col(name).isNotNull())
        .select(SERIES, F.concat("_l", F.array(*[F.col(c).cast("double") for c in exog])).alias("x") if exog else F.col("_l").alias("x"), F.array(name).alias("y"))
    )


def fit_autoregression(
    grid: DataFrame, step_seconds: int, p: int = 1, d: int = 1, exog: Sequence[str] = (), train: Column | None = None
) -> DataFrame:
    """Coefficients ``(series_id, h, w)`` of AR(p) on d-th differences: least squares per series over the
    rows that ``train`` marks (default: all). ``w`` holds the intercept, the lags, then the covariates."""
    return fit_linear(lag_rows(grid, step_seconds, p, d, exog, train), [SERIES])


def _orders(ps: list[int]):
    """Coefficients of each order from the cross products of the largest."""
    def each(flat) -> list[dict]:
        full = full_gram(flat)
        return [{"p": p, "w": solve_gram(full, np.arange(p + 1), np.array([len(full) - 1]))[0].tolist()} for p in ps]

    @F.pandas_udf("array<struct<p:int,w:array<double>>>")
    def solve(g: pd.Series) -> pd.Series:
        return pd.Series([each(flat) for flat in g])

    return solve


def fit_autoregressions(grid: DataFrame, step_seconds: int, orders: Sequence[tuple[int, int]], train: Column | None = None) -> DataFrame:
    """Coefficients ``(series_id, p, d, h, w)`` of every order ``(p, d)`` from one pass over the rows for each ``d``.

    The cross products of the largest ``p`` hold those of every smaller one, so an order is solved from a part of one matrix
    per series. All orders of one ``d`` are fitted on the same rows, those with as many lags as the largest needs.
    """
    found = None
    for d in sorted({d for _, d in orders}):
        ps = sorted({p for p, q in orders if q == d})
        grams = sum_grams(lag_rows(grid, step_seconds, ps[-1], d, train=train), [SERIES])
        part = grams.select(SERIES, F.explode(_orders(ps)("g")).alias("s")).select(SERIES, "s.p", F.lit(d).alias("d"), F.lit(1).alias("h"), "s.w")
        found = part if found is None else found.unionByName(part)
    return found


def autoregression(
    grid: DataFrame, step_seconds: int, horizon: int, p: int = 1, d: int = 1,
    exog: Sequence[str] = (), train: Column | None = None, lookback: int | None = None, coef: DataFrame | None = None, **kwargs,
) -> DataFrame:
    """AR(p) on d-th differences with optional known-ahead covariates.

    Coefficients are those given, or are fitted on the rows that ``train`` marks, by default those before
    the first origin of each series; the forecast recursion runs on the arrays of each origin, then integrates.
    """
    lookback = max(lookback or 0, p + d)
    if coef is None:
        rows = grid
        if train is None:
            rows = mark_origins(grid, step_seconds, lookback, horizon, keep_rel=True, **kwargs)
            train = F.col("rel") < 0
        coef = fit_autoregression(rows, step_seconds, p, d, exog, train)
    coef = coef.where("h = 1").select(SERIES, F.col("w").alias("_w"))
    z, name = _differenced(grid, step_seconds, p, d), f"_z{d}"
    base = z.select(SERIES, TS, *[f"_z{i}" for i in range(d + 1)], LOAD, *exog)
    o = origin_histories(
        base, step_seconds, lookback, horizon, columns=(name,), future=exog,
        last=[f"_z{i}" for i in range(d)], length=p, **kwargs,
    )
    o = attach(o, coef, [SERIES])
    intercept = F.col("_w")[0]
    ar = F.slice("_w", 2, p)
    hs = F.sequence(F.lit(1), F.lit(horizon))
    levels = F.array(*[F.col(f"last__z{i}") for i in range(d)]) if d else F.array().cast("array<double>")
    start = F.struct(
        F.reverse(F.col(f"hist_{name}")).alias("buf"), levels.alias("lv"), F.array().cast("array<double>").alias("out")
    )

    def step(acc: Column, i: Column) -> Column:
        value = intercept + F.aggregate(F.zip_with(ar, acc["buf"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        for k, c in enumerate(exog):
            value = value + F.col("_w")[1 + p + k] * F.get(F.col(f"fut_{c}"), i - 1)
        buf = F.slice(F.concat(F.array(value), acc["buf"]), 1, p)
        if d == 0:
            lv, out = acc["lv"], value
        elif d == 1:
            out = acc["lv"][0] + value
            lv = F.array(out)
        else:
            first = acc["lv"][1] + value
            out = acc["lv"][0] + first
            lv = F.array(out, first)
        return F.struct(buf.alias("buf"), lv.alias("lv"), F.concat(acc["out"], F.array(out)).alias("out"))

    path = F.aggregate(hs, start, step, lambda acc: acc["out"])
    rows = o.select(SERIES, "origin_ts", F.posexplode(path).alias("_i", "yhat")).withColumn("h", F.col("_i") + 1)
    rows = rows.withColumn(TS, add_seconds("origin_ts", F.col("_i") * step_seconds))
    return _finish(rows, "ARIMA")

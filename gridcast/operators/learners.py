"""Fitted forecasters: linear, residual correction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import LOAD, SERIES, TS, attach
from gridcast.functions.time import add_seconds
from gridcast.operators.features import temperature_features
from gridcast.session import settle

FORECAST = (SERIES, "model", "origin_ts", "h", TS, "yhat")
# Most bytes of partial matrices a task keeps before it hands them on.
HELD_BYTES = 64 << 20


def _partial_grams(keys: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush():
            out = pd.DataFrame([list(k) for k in held], columns=list(keys))
            out["g"] = [g[np.triu_indices(len(g))].tolist() for g, _ in held.values()]
            out["m"] = [m for _, m in held.values()]
            held.clear()
            return out

        for pdf in batches:
            for key, part in pdf.groupby(list(keys), sort=False, dropna=False):
                x = np.vstack(part["x"].to_numpy())
                y = np.vstack(part["y"].to_numpy())
                z = np.hstack([np.ones((len(part), 1)), x, y])
                key = key if isinstance(key, tuple) else (key,)
                gram = z.T @ z
                held[key] = (held[key][0] + gram if key in held else gram, y.shape[1])
                if sum(g.nbytes for g, _ in held.values()) >= HELD_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def sum_grams(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, g, m``: the cross products of (1, x, y) over all rows of a key, as an upper triangle, and the number of targets.

    ``rows`` hold arrays ``x`` and ``y``. Each task reduces its rows to one cross-product matrix per key; the upper triangles are summed
    by Spark as vectors, combined before the shuffle, so a series of any length is summed by all tasks that hold part of it.
    """
    schema = rows.select(*keys).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    partial = rows.select(*keys, "x", "y").mapInPandas(_partial_grams(keys), f"{ddl}, g array<double>, m int")
    summed = partial.groupBy(*keys).agg(Summarizer.sum(array_to_vector("g")).alias("_g"), F.max("m").alias("m"))
    return summed.select(*keys, vector_to_array("_g").alias("g"), "m")


def full_gram(flat: Sequence[float]) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    side = int(((8 * len(flat) + 1) ** 0.5 - 1) / 2 + 0.5)
    full = np.zeros((side, side))
    full[np.triu_indices(side)] = flat
    return full + np.triu(full, 1).T


def solve_gram(full: np.ndarray, used: np.ndarray, targets: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Least squares of the ``targets`` rows of a cross-product matrix on its ``used`` rows (the intercept first); a row per target.

    Collinear features get the minimum-norm solution; ``ridge`` penalises the slopes, not the intercept.
    """
    a, b = full[np.ix_(used, used)], full[np.ix_(used, targets)]
    if ridge:
        a = a + np.diag([0.0] + [ridge] * (len(used) - 1))
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    return (np.linalg.lstsq(a / np.outer(scale, scale), b / scale[:, None], rcond=1e-12)[0] / scale[:, None]).T


def fit_linear(rows: DataFrame, keys: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """Least squares of every target on the features, one model per key: ``(keys, h, w)`` with the intercept first in ``w``.

    Only a p x p system per key is solved from the sums of :func:`sum_grams`. Collinear features get the minimum-norm solution.
    ``ridge`` penalises the slopes, not the intercept.
    """
    @F.pandas_udf("array<array<double>>")
    def solve(g: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for flat, n in zip(g, m):
            full = full_gram(flat)
            p = len(full) - int(n)
            out.append(solve_gram(full, np.arange(p), np.arange(p, len(full)), ridge).tolist())
        return pd.Series(out)

    solved = sum_grams(rows, keys).select(*keys, solve("g", "m").alias("ws"))
    return solved.select(*keys, F.posexplode("ws").alias("_i", "w")).select(
        *keys, (F.col("_i") + 1).alias("h"), "w"
    )


def dot(w: Column, x: Column) -> Column:
    """Intercept plus the inner product of slopes and features."""
    slopes = F.slice(w, 2, F.size(x))
    return w[0] + F.aggregate(F.zip_with(slopes, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def predict_linear(origins_x: DataFrame, coef: DataFrame, step_seconds: int, horizon: int, model: str = "LinearRegression") -> DataFrame:
    """Forecast every step of every origin row ``(series_id, ts, x)``."""
    table = coef.groupBy(SERIES).agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("_c"))  # one row per step
    scored = attach(origins_x.select(SERIES, F.col(TS).alias("origin_ts"), "x"), table, [SERIES], salts=8)
    steps = F.transform(
        F.filter("_c", lambda c: c["h"] <= horizon), lambda c: F.struct(c["h"].alias("h"), dot(c["w"], F.col("x")).alias("yhat"))
    )
    scored = scored.select(SERIES, "origin_ts", F.inline(steps))
    return scored.select(
        SERIES, F.lit(model).alias("model"), "origin_ts", "h",
        add_seconds("origin_ts", (F.col("h") - 1) * step_seconds).alias(TS), "yhat",
    )


# -- residual correction ---------------------------------------------------------------------


def _moments(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy(SERIES).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_d_{c}") for c in columns]
    )


def _standardised(rows: DataFrame, moments: DataFrame, columns: Sequence[str]) -> DataFrame:
    d = attach(rows, moments, [SERIES])
    z = [
        F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).otherwise(1.0), F.lit(0.0))
        for c in columns
    ]
    return d.withColumn("x", F.array(*z)).drop(*[f"_m_{c}" for c in columns], *[f"_d_{c}" for c in columns])


def residual_correction(
    forecasts: DataFrame,
    readings: DataFrame,
    covariates: Sequence[str],
    train: Column,
    alpha: float = 1.0,
    temperature: str | None = None,
    knots: DataFrame | None = None,
    n_knots: int = 3,
) -> DataFrame:
    """Correct any base forecast by ridge regression of its residuals.

    Features are the covariates (absent ones count as zero) and, with a
    temperature column, degree and spline features in raw units, standardised
    over the training rows. ``train`` selects forecast rows to fit on.
    """
    absent = [c for c in covariates if c not in readings.columns]
    r = readings.select(SERIES, TS, F.col(LOAD).alias("actual"), *[F.col(c).cast("double") for c in covariates if c not in absent],
                        *[F.lit(0.0).alias(c) for c in absent])
    columns = list(covariates)
    d = forecasts.join(r, [SERIES, TS])
    if temperature:
        d = temperature_features(d, temperature, knots, n_knots)
        columns += ["temp_hdd", "temp_cdd", *[f"temp_spline_{i}" for i in range(n_knots)]]
    d = settle(d)  # read for the moments, the fit and the correction
    fit = d.where(train & F.col("actual").isNotNull())
    moments = _moments(fit, columns)
    xy = _standardised(fit, moments, columns).select(SERIES, "x", F.array(F.col("actual") - F.col("yhat")).alias("y"))
    coef = fit_linear(xy, [SERIES], ridge=alpha).where("h = 1").drop("h")
    scored = attach(_standardised(d, moments, columns), coef, [SERIES])
    return scored.select(
        SERIES, F.concat("model", F.lit("+Residual")).alias("model"), "origin_ts", "h", TS,
        (F.col("yhat") + dot(F.col("w"), F.col("x"))).alias("yhat"), F.col("yhat").alias("base_yhat"),
    )

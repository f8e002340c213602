"""Calendar, lag, scaling, temperature and noise features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import (
    BLK, LOAD, SERIES, TS, attach, block_seconds, exact_percentiles, haloed, in_block, up_to_here, with_summary,
)
from gridcast.functions.time import calendar, epoch, hours_to_steps
from gridcast.operators.grid import ensure_blocked

# Lags of the target, degree bases, quantiles of the knots.
LAG_HOURS = (24, 48, 168)
HEATING_BASE, COOLING_BASE = 18.0, 22.0


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar(TS))


def lag_features(
    df: DataFrame, step_seconds: int, lag_hours: Sequence[int] = LAG_HOURS, value: str = LOAD
) -> DataFrame:
    """``lag_{h}h`` columns on a regular grid.

    A missing lag takes the value known before it, and a warm-up row the
    series' first known value; ``lag_ready`` is false on warm-up rows. Lags
    reach into the block before through a halo.
    """
    known = F.when(F.col(value).isNotNull(), F.col(TS))
    d = with_summary(
        ensure_blocked(df, step_seconds),
        [F.max_by(value, known).alias("_l"), F.min_by(value, known).alias("_f"), F.min(known).alias("_ft"), F.min(TS).alias("_t0")],
        lambda before, after, whole: [
            F.last("_l", True).over(before).alias("_carry"),
            F.min_by("_f", "_ft").over(whole).alias("_first"), F.min("_t0").over(whole).alias("_start"),
        ],
    )
    d = d.withColumn("_pv", F.coalesce(F.last(value, True).over(up_to_here()), F.col("_carry"))).drop(BLK, "_carry")
    steps = {h: hours_to_steps(h, step_seconds) for h in lag_hours}
    longest = max(steps.values())
    h = haloed(d, block_seconds(step_seconds, longest), before=longest * step_seconds)
    w = in_block()
    lags = {
        f"lag_{hours}h": F.coalesce(F.lag("_pv", k).over(w), F.col("_first")) for hours, k in steps.items()
    }
    ready = epoch(TS) >= epoch("_start") + longest * step_seconds
    return (
        h.withColumns(lags)
        .withColumn("lag_ready", ready)
        .where("_own")
        .drop("_own", "_pv", "_first", "_start", BLK)
    )


def fit_scaler(df: DataFrame, columns: Sequence[str], role: str | None = "role") -> DataFrame:
    """Min and max per series and column, over training rows only."""
    rows = df.where(F.col(role) == "training") if role else df
    wide = rows.groupBy(SERIES).agg(
        *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]
    )
    return wide.select(
        SERIES,
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.lo"), F.col(f"{c}.hi")) for c in columns])),
    )


def _scaler_wide(params: DataFrame, columns: Sequence[str]) -> DataFrame:
    return params.groupBy(SERIES).agg(
        *[F.max(F.when(F.col("column") == c, F.struct("lo", "hi"))).alias(f"_s_{c}") for c in columns]
    )


def scale(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Map training min..max to 0..1; a constant column becomes 0."""
    d = attach(df, _scaler_wide(params, columns), [SERIES])
    for c in columns:
        lo, hi = F.col(f"_s_{c}.lo"), F.col(f"_s_{c}.hi")
        d = d.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c) - lo))
    return d.drop(*[f"_s_{c}" for c in columns])


def unscale(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse of :func:`scale`."""
    d = attach(df, _scaler_wide(params, columns), [SERIES])
    for c in columns:
        lo, hi = F.col(f"_s_{c}.lo"), F.col(f"_s_{c}.hi")
        d = d.withColumn(c, F.when(hi > lo, F.col(c) * (hi - lo) + lo).otherwise(F.col(c) + lo))
    return d.drop(*[f"_s_{c}" for c in columns])


def temperature_knots(df: DataFrame, temperature: str, n: int = 3) -> DataFrame:
    """Spline knots per series: quantiles evenly spaced over 10..90 %."""
    grid = [0.1 + 0.8 * i / (n - 1) for i in range(n)] if n > 1 else [0.1]
    return exact_percentiles(df, [SERIES], temperature, {f"knot_{i}": p for i, p in enumerate(grid)})


def degree_columns(
    temperature: str | Column, heating: float = HEATING_BASE, cooling: float = COOLING_BASE
) -> dict[str, Column]:
    t = F.col(temperature) if isinstance(temperature, str) else temperature
    return {"temp_hdd": F.greatest(F.lit(0.0), heating - t), "temp_cdd": F.greatest(F.lit(0.0), t - cooling)}


def temperature_features(
    df: DataFrame, temperature: str, knots: DataFrame, n: int = 3,
    heating: float = HEATING_BASE, cooling: float = COOLING_BASE,
) -> DataFrame:
    """Heating and cooling degrees and a truncated cubic basis, in raw units."""
    d = attach(df, knots, [SERIES], "left")
    basis = {
        f"temp_spline_{i}": F.pow(F.greatest(F.lit(0.0), F.col(temperature) - F.col(f"knot_{i}")), 3)
        for i in range(n)
    }
    return d.withColumns({**degree_columns(temperature, heating, cooling), **basis}).drop(
        *[f"knot_{i}" for i in range(n)]
    )


def add_noise(df: DataFrame, stds: dict[str, float], seed: int = 42, role: str = "role") -> DataFrame:
    """Gaussian noise on covariates of training rows.

    The draw is a function of series, time, column and seed (Box-Muller on two
    hashes), so a lost and recomputed task gives the same rows.
    """
    def uniform(name: str, k: int) -> Column:
        h = F.xxhash64(SERIES, TS, F.lit(name), F.lit(seed), F.lit(k))
        return (F.pmod(h, F.lit(2**52)) + 1) / F.lit(float(2**52 + 1))

    out = df
    for name, std in stds.items():
        z = F.sqrt(-2 * F.log(uniform(name, 0))) * F.cos(2 * F.pi() * uniform(name, 1))
        out = out.withColumn(
            name, F.when(F.col(role) == "training", F.col(name) + std * z).otherwise(F.col(name))
        )
    return out

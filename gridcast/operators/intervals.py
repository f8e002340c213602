"""Forecast bands from validation residuals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import SERIES, TS, attach, exact_percentiles

# Default quantile levels.
DEFAULT_LEVELS = (0.1, 0.5, 0.9)


def validate_levels(levels: Iterable[float] | None = None) -> list[float]:
    """Sorted distinct levels strictly inside (0, 1), the median always among them."""
    if levels is None:
        return list(DEFAULT_LEVELS)
    try:
        values = [float(q) for q in levels]
    except (TypeError, ValueError) as e:
        raise ValueError(f"levels must be numbers in (0, 1): {levels!r}") from e
    if not values:
        raise ValueError("at least one level is needed")
    bad = [q for q in values if not 0 < q < 1]
    if bad:
        raise ValueError(f"levels must lie strictly between 0 and 1: {bad}")
    return sorted({*values, 0.5})


def level_column(q: float) -> str:
    """Column of a level: ``q0_1`` for 0.1."""
    return "q" + f"{q:g}".replace(".", "_")


def residual_quantiles(
    scored: DataFrame, levels: Iterable[float] | None = None, keys: Sequence[str] = (SERIES, "h")
) -> DataFrame:
    """Exact residual quantiles per series and step ahead (validation rows)."""
    qs = validate_levels(levels)
    rows = scored.select(*keys, (F.col("actual") - F.col("yhat")).alias("_e"))
    return exact_percentiles(rows, list(keys), "_e", {f"_r{level_column(q)}": q for q in qs})


def add_bands(forecasts: DataFrame, quantiles: DataFrame, levels: Iterable[float] | None = None, keys: Sequence[str] = (SERIES, "h")) -> DataFrame:
    """Shift each forecast by the residual quantiles of its step; the point
    forecast becomes the median."""
    names = [level_column(q) for q in validate_levels(levels)]
    d = attach(forecasts, quantiles, list(keys), salts=8)
    d = d.withColumns({n: F.col("yhat") + F.col(f"_r{n}") for n in names})
    return d.withColumn("yhat", F.col(level_column(0.5))).drop(*[f"_r{n}" for n in names])


def attach_quantiles(predictions: DataFrame, bands: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Band columns onto prediction rows by time; unmatched rows stay.

    Windows may overlap: of several bands for one time the newest ``origin_ts`` holds. Bands without
    ``origin_ts`` must be unique by series and time; repeated ones fail the job instead of multiplying rows.
    """
    values = F.struct(*columns)
    if "origin_ts" in bands.columns:
        one = F.max_by(values, "origin_ts")
    else:
        repeated = F.raise_error(F.lit("several bands for one series and time")).cast("boolean")
        one = F.when(F.when(F.count(F.lit(1)) > 1, repeated).otherwise(True), F.any_value(values))
    single = bands.groupBy(SERIES, TS).agg(one.alias("_band")).select(SERIES, TS, *[F.col(f"_band.{c}").alias(c) for c in columns])
    return predictions.join(single, [SERIES, TS], "left")


def attach_window_bands(steps: DataFrame, bands: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Band columns onto window steps by ``(series_id, origin_ts, ts)``."""
    keys = [SERIES, "origin_ts", TS]
    return steps.join(bands.select(*keys, *columns), keys, "left")

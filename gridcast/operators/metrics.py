"""Scores of forecasts against readings. All results are unrounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import LOAD, SERIES, TS, attach, block_seconds, blocked, in_block, with_summary
from gridcast.functions.time import WEEKDAYS, epoch

METRICS = ("rmse", "mae", "mape", "cv_rmse", "r_squared")
SIMILAR_POINTS = 5.0


def score(forecasts: DataFrame, readings: DataFrame) -> DataFrame:
    """Pair forecasts with readings at the same series and time.

    Forecasts that already carry ``actual`` are only filtered.
    """
    if "actual" in forecasts.columns:
        return forecasts.where(F.col("actual").isNotNull() & F.col("yhat").isNotNull())
    actual = readings.select(SERIES, TS, F.col(LOAD).alias("actual"))
    return forecasts.join(actual, [SERIES, TS]).where(F.col("actual").isNotNull() & F.col("yhat").isNotNull())


def _metric_columns(a: Column, p: Column) -> dict[str, Column]:
    e = a - p
    rmse = F.sqrt(F.avg(e * e))
    mean = F.avg(a)
    n, var = F.count(a), F.var_pop(a)
    infinite = F.lit(float("inf"))
    return {
        "n": n,
        "rmse": rmse,
        "mae": F.avg(F.abs(e)),
        "mape": F.when(n > 0, F.coalesce(100 * F.avg(F.when(a != 0, F.abs(e / F.when(a != 0, a)))), infinite)),
        "cv_rmse": F.when(n > 0, F.when(mean != 0, 100 * rmse / F.when(mean != 0, mean)).otherwise(infinite)),
        "r_squared": F.when(n > 0, F.when(var > 0, 1 - F.sum(e * e) / (n * F.when(var > 0, var))).otherwise(0.0)),
    }


def point_metrics(scored: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """RMSE, MAE, MAPE, CV-RMSE and R2 per key, combined before the shuffle."""
    cols = _metric_columns(F.col("actual"), F.col("yhat"))
    return scored.groupBy(*keys).agg(*[c.alias(k) for k, c in cols.items()])


def metric_sets(scored: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """The same metrics for several groupings in one pass (GROUPING SETS)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    cols = _metric_columns(F.col("actual"), F.col("yhat"))
    return scored.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        *[c.alias(k) for k, c in cols.items()]
    )


def window_metrics(scored: DataFrame) -> DataFrame:
    """MAE and RMSE of every forecast window."""
    e = F.col("actual") - F.col("yhat")
    return scored.groupBy(SERIES, "model", "origin_ts").agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def chunk_metrics(scored: DataFrame, chunk_lengths: DataFrame, least: int) -> DataFrame:
    """Pool the residuals of chunks longer than ``least`` steps.

    ``scored`` rows and ``chunk_lengths`` share ``(series_id, chunk_id)``.
    """
    long = chunk_lengths.where(F.col("n_rows") > least).select(SERIES, "chunk_id")
    return point_metrics(attach(scored, long, [SERIES, "chunk_id"]))


def peak_days(scored: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Daily peaks, actual against forecast, over the full calendar day.

    ``scored`` must hold one row per time (:func:`flatten`). With ``days``
    (``series_id, date``) days without data stay as rows with NULLs.
    """
    d = scored.groupBy(SERIES, F.to_date(TS).alias("date")).agg(
        F.max("actual").alias("actual_peak"),
        F.max("yhat").alias("predicted_peak"),
        F.hour(F.max_by(TS, F.struct("actual", -epoch(TS)))).alias("actual_hour"),
        F.hour(F.max_by(TS, F.struct("yhat", -epoch(TS)))).alias("predicted_hour"),
    )
    if days is not None:
        d = days.select(SERIES, "date").join(d, [SERIES, "date"], "left")
    ok = F.col("actual_peak").isNotNull() & (F.col("actual_peak") != 0)
    return d.withColumn("evaluated", ok).withColumn(
        "peak_error_pct",
        F.when(ok, 100 * F.abs(F.col("actual_peak") - F.col("predicted_peak")) / F.when(ok, F.col("actual_peak"))),
    ).withColumn("timing_error_h", F.when(ok, F.abs(F.col("actual_hour") - F.col("predicted_hour"))))


def peak_summary(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy(SERIES).agg(
        F.avg("peak_error_pct").alias("peak_mape"),
        F.avg("timing_error_h").alias("peak_timing_error_h"),
        F.count_if("evaluated").alias("n_evaluated"),
        F.count_if(~F.col("evaluated")).alias("n_skipped"),
    )


def flatten(forecasts: DataFrame, lead: str = "longest") -> DataFrame:
    """One forecast per series and time from overlapping windows.

    ``longest`` keeps the earliest origin, ``shortest`` the latest.
    """
    pick = {"longest": F.min_by, "shortest": F.max_by}[lead]
    rest = [c for c in forecasts.columns if c not in (SERIES, "model", TS, "origin_ts")]
    edge = {"longest": F.min, "shortest": F.max}[lead]
    return forecasts.groupBy(SERIES, "model", TS).agg(
        edge("origin_ts").alias("origin_ts"), *[pick(c, "origin_ts").alias(c) for c in rest]
    )


def residual_diagnostics(scored: DataFrame, step_seconds: int) -> DataFrame:
    """Mean, population deviation and lag-1 autocorrelation of residuals.

    ``scored`` must hold one row per time. NULLs below two residuals; an
    undefined correlation counts as 0.
    """
    d = blocked(
        scored.select(SERIES, TS, (F.col("actual") - F.col("yhat")).alias("e")), block_seconds(step_seconds)
    )
    d = with_summary(
        d,
        [F.max_by("e", TS).alias("_v")],
        lambda before, after, whole: [F.last("_v", True).over(before).alias("_carry")],
    )
    d = d.withColumn("_prev", F.coalesce(F.lag("e").over(in_block()), F.col("_carry")))
    n = F.count("e")
    r = F.corr("e", "_prev")
    return d.groupBy(SERIES).agg(
        n.alias("n"),
        F.when(n >= 2, F.avg("e")).alias("mean_residual"),
        F.when(n >= 2, F.stddev_pop("e")).alias("std_residual"),
        F.when(n >= 2, F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))).alias("autocorrelation_lag1"),
    )


def horizon_metrics(scored: DataFrame, keys: Sequence[str] = (SERIES, "model")) -> DataFrame:
    """RMSE, MAE and MAPE per step ahead; NULL below two pairs."""
    d = point_metrics(scored, [*keys, "h"])
    return d.select(*keys, "h", "n", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("rmse", "mae", "mape")])


def horizon_coverage(scored: DataFrame, lo: str, hi: str, keys: Sequence[str] = (SERIES, "model")) -> DataFrame:
    """Share of readings inside the band and its mean width, per step ahead."""
    inside = F.col("actual").between(F.col(lo), F.col(hi)).cast("double")
    return scored.groupBy(*keys, "h").agg(
        F.avg(inside).alias("coverage"), F.avg(F.col(hi) - F.col(lo)).alias("mean_width"), F.count(F.lit(1)).alias("n")
    )


def quantile_rows(scored: DataFrame, levels: dict[str, float]) -> DataFrame:
    """Band columns to rows ``(..., q, yq)``."""
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("yq")) for c, q in levels.items()])
    return scored.select(*[c for c in scored.columns if c not in levels], F.inline(pairs))


def pinball(scored: DataFrame, levels: dict[str, float], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Pinball loss per level, scored by key and time."""
    d = F.col("actual") - F.col("yq")
    return quantile_rows(scored, levels).groupBy(*keys, "q").agg(
        F.avg(F.greatest(F.col("q") * d, (F.col("q") - 1) * d)).alias("pinball")
    )


def interval_metrics(scored: DataFrame, levels: dict[str, float], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Mean pinball loss and the coverage and width of the outermost band."""
    lo, hi = min(levels, key=levels.get), max(levels, key=levels.get)
    loss = F.lit(0.0)
    for c, q in levels.items():
        d = F.col("actual") - F.col(c)
        loss = loss + F.greatest(q * d, (q - 1) * d)
    band = levels[hi] > levels[lo]
    inside = F.col("actual").between(F.col(lo), F.col(hi)).cast("double")
    return scored.groupBy(*keys).agg(
        F.avg(loss / len(levels)).alias("pinball_loss"),
        (F.avg(inside) if band else F.lit(None).cast("double")).alias("coverage"),
        (F.max(F.lit(levels[hi] - levels[lo])) if band else F.lit(None).cast("double")).alias("nominal_coverage"),
        (F.avg(F.col(hi) - F.col(lo)) if band else F.lit(None).cast("double")).alias("mean_width"),
    )


def compare_to_validation(test: DataFrame, runs: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Is the test CV-RMSE like the validation one (within 5 points)?"""
    d = test.select(*keys, F.col("cv_rmse").alias("test_cv_rmse")).join(
        runs.select(*keys, F.col("cv_rmse").alias("validation_cv_rmse")), [*keys], "left"
    )
    diff = F.col("test_cv_rmse") - F.col("validation_cv_rmse")
    return d.withColumn("cv_rmse_diff", diff).withColumn(
        "performance_status",
        F.when(diff.isNull(), "unknown").when(F.abs(diff) <= SIMILAR_POINTS, "similar")
        .when(diff > 0, "degraded").otherwise("improved"),
    )


def error_by_hour(scored: DataFrame) -> DataFrame:
    """MAE per hour of day; hours without rows stay with NULL."""
    mae = scored.groupBy(SERIES, F.hour(TS).alias("hour")).agg(F.avg(F.abs(F.col("actual") - F.col("yhat"))).alias("mae"))
    spine = scored.select(SERIES).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spine.join(mae, [SERIES, "hour"], "left")


def error_by_weekday(scored: DataFrame) -> DataFrame:
    """MAE per weekday (Monday 0); days without rows stay with NULL."""
    mae = scored.groupBy(SERIES, F.weekday(TS).alias("dow")).agg(F.avg(F.abs(F.col("actual") - F.col("yhat"))).alias("mae"))
    spine = scored.select(SERIES).distinct().withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6))))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return spine.join(mae, [SERIES, "dow"], "left").withColumn("label", names[F.col("dow")])


def backtest_summary(scored: DataFrame, stride: int) -> DataFrame:
    """Windows, stride and scored time range per series.

    Origins are made distinct in their own grouping, so no task gathers the
    origins of a whole series.
    """
    per = scored.groupBy(SERIES, "model", "origin_ts").agg(F.min(TS).alias("a"), F.max(TS).alias("b"), F.count(F.lit(1)).alias("c"))
    return per.groupBy(SERIES, "model").agg(
        F.count(F.lit(1)).alias("n_windows"), F.lit(stride).alias("stride"),
        F.min("a").alias("first_scored_ts"), F.max("b").alias("last_scored_ts"), F.sum("c").alias("n_scored"),
    )


def peak_demand_day(readings: DataFrame) -> DataFrame:
    """The day with the highest reading of each series."""
    daily = readings.groupBy(SERIES, F.to_date(TS).alias("date")).agg(F.max(LOAD).alias("peak"))
    return daily.groupBy(SERIES).agg(
        F.max_by("date", F.struct("peak", -F.datediff("date", F.lit("1970-01-01").cast("date")))).alias("date"),
        F.max("peak").alias("peak"),
    )

"""Tables behind the data, training and backtest reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.blocks import LOAD, SERIES, TS
from gridcast.operators import metrics, outliers, profile
from gridcast.operators.grid import gaps
from gridcast.operators.splits import role_codes, seasonal_split, season_spans, segment_summary, segments

# Tolerances of the curve diagnostics.
VAL_RISE, STILL_IMPROVING = 0.05, 0.01


def data_report(df: DataFrame, step_seconds: int, covariates: Sequence[str] = (), mapped: Sequence[str] = (), plot_points: int | None = None, scatter: int | None = None) -> dict[str, DataFrame]:
    """All exploration tables of a dataset, each a DataFrame.

    All of them use all rows. Only ``plot_points`` thins the plotted series, and only ``scatter`` adds samples of so many rows.
    """
    split = seasonal_split(df, step_seconds)
    segs = segments(split, step_seconds)
    roles = {LOAD: "target", **{c: "past_covariate" for c in covariates}}
    known = {SERIES, TS, LOAD, *covariates, *mapped}
    out = {
        "columns": profile.column_stats(df, roles),
        "time_range": profile.time_range(df, step_seconds),
        "gaps": gaps(df, step_seconds),
        "season_spans": season_spans(df, step_seconds),
        "value_outliers": outliers.value_outliers(df),
        "spikes": outliers.spikes(df, step_seconds),
        "profiles": profile.load_profiles(df),
        "heat_map": profile.heat_map(df),
        "peak_windows": profile.peak_windows(df),
        "segments": segs,
        "split_summary": segment_summary(segs),
        "series": role_codes(split) if plot_points is None else outliers.thin(role_codes(split), step_seconds, plot_points),
        "unmapped": df.sparkSession.createDataFrame([(c,) for c in df.columns if c not in known], "column_name string"),
    }
    if covariates:
        out["correlation"] = profile.covariate_correlation(df, covariates)
        for c in covariates:
            out[f"relation_{c}"] = profile.relation_curve(df, c)
            if scatter:
                out[f"scatter_{c}"] = profile.scatter_sample(df, c, scatter)
    return out


def input_preview(df: DataFrame, covariates: Sequence[str] = ()) -> DataFrame:
    """Known target and covariate points in long form."""
    columns = [LOAD, *covariates]
    return df.select(SERIES, TS, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [SERIES, TS], columns, "column", "v"
    ).where("v is not null")


def curve_diagnostics(curve: DataFrame) -> DataFrame:
    """Best and final point of each learning curve, and what they say.

    ``curve`` rows are ``(model_id, x, train, val)``, one per round; a model
    has at most a few hundred.
    """
    v = curve.where("val is not null")
    w = Window.partitionBy("model_id").orderBy("x")
    last = v.withColumn("prev_val", F.lag("val").over(w)).groupBy("model_id").agg(
        F.min_by("x", F.struct("val", "x")).alias("best_x"), F.min("val").alias("best_val"),
        F.max("x").alias("last_x"), F.max_by("val", "x").alias("final_val"),
        F.max_by("prev_val", "x").alias("prev_val"), F.count(F.lit(1)).alias("n_val"),
    )
    whole = curve.groupBy("model_id").agg(F.max_by("train", "x").alias("final_train"), F.count(F.lit(1)).alias("n_points"))
    over = (F.col("best_x") != F.col("last_x")) & (F.col("best_val") != 0) & (F.col("final_val") > F.col("best_val") * (1 + VAL_RISE))
    under = (
        (F.col("n_val") >= 3) & (F.col("best_x") == F.col("last_x")) & (F.col("prev_val") != 0)
        & ((F.col("prev_val") - F.col("final_val")) / F.col("prev_val") > STILL_IMPROVING)
    )
    return whole.join(last, "model_id", "left").select(
        "model_id", "n_points", "best_x", "best_val", "final_train", "final_val",
        F.when(F.col("final_train") > 0, F.round(F.col("final_val") / F.col("final_train"), 3)).alias("gap_ratio"),
        F.coalesce(over, F.lit(False)).alias("over_trained"), F.coalesce(under, F.lit(False)).alias("still_improving"),
    )


def average_curves(curve: DataFrame, name: str = "model_id") -> DataFrame:
    """Mean loss per round over the step-ahead models of a run."""
    return curve.groupBy(name, "x").agg(F.avg("train").alias("train"), F.avg("val").alias("val"))


def tuning_study(trials: DataFrame, key: str | None = None) -> DataFrame:
    """Every trial with the best score so far; a study has few trials."""
    keys = [key] if key else []
    w = Window.partitionBy(*keys).orderBy("trial").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("best_so_far", F.min("cv_rmse").over(w)).withColumn("failed", F.col("cv_rmse").isNull())


def tuning_summary(trials: DataFrame, key: str | None = None) -> DataFrame:
    keys = [key] if key else []
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if(F.col("cv_rmse").isNull()).alias("n_failed"),
        F.min_by("trial", F.struct(F.col("cv_rmse").isNull(), "cv_rmse", "trial")).alias("best_trial"),
        F.min("cv_rmse").alias("best_cv_rmse"),
    )


def varied_parameters(trials: DataFrame) -> DataFrame:
    """Numeric parameters that took more than one value."""
    p = trials.select(F.explode("params").alias("name", "value")).where(F.expr("try_cast(value AS double)").isNotNull())
    return p.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")


def model_comparison(runs: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Rank the runs of each series by validation CV-RMSE, missing last."""
    w = Window.partitionBy(*keys).orderBy(F.col("cv_rmse").asc_nulls_last(), "model_id")
    ratio = F.when(F.col("train_cv_rmse") > 0, F.col("cv_rmse") / F.col("train_cv_rmse"))
    return runs.select(
        *keys, "model_id", "model_type", "train_cv_rmse", "cv_rmse",
        F.row_number().over(w).alias("rank"), F.coalesce(ratio > 2.0, F.lit(False)).alias("overfit"),
    )


def backtest_report(scored: DataFrame, step_seconds: int, stride: int) -> dict[str, DataFrame]:
    """The tables of an evaluation or backtest report."""
    flat = metrics.flatten(scored)
    days = metrics.peak_days(flat)
    return {
        "metrics": metrics.point_metrics(scored, [SERIES, "model"]),
        "predictions": flat.withColumn("residual", F.col("actual") - F.col("yhat")),
        "windows": metrics.window_metrics(scored),
        "by_hour": metrics.error_by_hour(flat),
        "by_weekday": metrics.error_by_weekday(flat),
        "peaks": days.withColumn("model_rows", F.lit(1)),
        "summary": metrics.backtest_summary(scored, stride),
        "residuals": metrics.residual_diagnostics(flat, step_seconds),
    }

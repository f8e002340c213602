"""Data and run checks: one profile row per series, flags, verdicts, guardrails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import LOAD, SERIES, TS
from gridcast.functions.time import STEP_SECONDS, epoch, frequency_label, supported
from gridcast.operators.grid import fill_all, gaps, off_grid, regular_grid
from gridcast.operators.outliers import spikes, value_outliers
from gridcast.sources.catalog import median_gap
from gridcast.sources.readings import DataLoadError, deduplicate

# Thresholds of the checks.
MIN_COVERAGE, MIN_SPAN_DAYS, ADVISED_ROWS, WEEK_HOURS = 0.90, 365, 500, 168
WEAK_DIURNAL, OVERFIT_RATIO, MAX_FINE_HORIZON, SPARE_ROWS = 1.05, 2.0, 96, 100
BLOCKING_FLAGS = ("LOAD_ERROR", "UNSUPPORTED_FREQUENCY")


def target_coverage(df: DataFrame) -> DataFrame:
    """Share of existing rows with a target, before any filling."""
    return df.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(LOAD).alias("n_known")
    ).withColumn("coverage", F.col("n_known") / F.col("n_rows")).withColumn(
        "passes", F.col("coverage") >= MIN_COVERAGE
    )


def infer_frequency(df: DataFrame) -> DataFrame:
    """Median gap between distinct times and the cadence it stands for."""
    return median_gap(df.select(SERIES, TS), [SERIES]).withColumn("frequency", frequency_label("median_gap_s"))


def frequency_verdict(df: DataFrame, declared: str | None = None) -> DataFrame:
    """Declared against inferred cadence, with a recommendation."""
    d = infer_frequency(df).withColumn("declared", F.lit(declared).cast("string"))
    match = F.col("declared").isNull() | F.col("declared").eqNullSafe(F.col("frequency"))
    return d.withColumn("matches", match).withColumn("supported", supported("frequency")).withColumn(
        "recommendation",
        F.when(~match & F.col("frequency").isNotNull(), F.concat(F.lit("declare "), F.col("frequency")))
        .when(F.col("frequency").isNull(), "resample to 15min, 30min or h"),
    )


def cadence_mismatch(runs: DataFrame, df: DataFrame) -> DataFrame:
    """Runs trained on another cadence than the new data: a hard error."""
    return runs.join(infer_frequency(df).select(SERIES, F.col("frequency").alias("data_frequency")), SERIES).where(
        ~F.col("frequency").eqNullSafe(F.col("data_frequency"))
    )


def negative_targets(df: DataFrame) -> DataFrame:
    return df.groupBy(SERIES).agg(
        F.count_if(F.col(LOAD) < 0).alias("n_negative"), F.count(LOAD).alias("n_known")
    )


def apply_missing_policy(df: DataFrame, policy: str, step_seconds: int, columns: Sequence[str] = (LOAD,)) -> DataFrame:
    """``interpolate``, ``drop`` rows with any NULL, or ``error`` on the first one."""
    if policy == "interpolate":
        out = df
        for c in columns:
            out = fill_all(out, step_seconds, c).drop("interpolated")
        return out
    if policy == "drop":
        return df.dropna(subset=list(columns))
    if policy == "error":
        bad = F.lit(False)
        for c in columns:
            bad = bad | F.col(c).isNull()
        checked = F.when(bad, F.raise_error(F.lit("missing values")).cast("double")).otherwise(F.col(columns[0]))
        return df.withColumn(columns[0], checked)
    raise DataLoadError(f"unknown policy {policy!r}")


def series_profile(df: DataFrame, step_seconds: int, order: str | None = None) -> DataFrame:
    """One wide row per series with everything the flags are based on."""
    order = order or LOAD
    unique = (
        deduplicate(df.select(SERIES, TS, LOAD, order), order)
        if order != LOAD
        else df.groupBy(SERIES, TS).agg(F.min(LOAD).alias(LOAD), F.count(F.lit(1)).alias("n_copies"))
    )
    base = unique.groupBy(SERIES).agg(
        F.sum("n_copies").alias("n_rows_raw"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(LOAD).isNull()).alias("n_missing"),
        F.count_if(F.col(LOAD) < 0).alias("n_negative"),
        F.count_if(F.col(LOAD) == 0).alias("n_zero"),
        F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"),
        F.count_if(F.month(TS).isin(3, 11)).alias("n_dst_months"),
    )
    freq = infer_frequency(unique)
    gap = gaps(unique, step_seconds).groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.sum("missing_steps").alias("missing_steps")
    )
    high = value_outliers(unique).groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_outliers"))
    jump = spikes(unique, step_seconds).groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_spikes"))
    hourly = unique.where(F.col(LOAD).isNotNull()).groupBy(SERIES, F.hour(TS).alias("hour")).agg(
        F.avg(LOAD).alias("m"), F.count(F.lit(1)).alias("n")
    )
    ratio = hourly.groupBy(SERIES).agg(
        F.when(F.sum("n") >= 48, F.max("m") / F.greatest(F.min("m"), F.lit(1e-9))).alias("hourly_ratio")
    )
    steps = F.floor((epoch("end_ts") - epoch("start_ts")) / step_seconds) + 1
    out = base
    for part in (freq, gap, high, jump, ratio):  # one row per series on both sides
        out = out.join(part, SERIES, "left")
    counts = ["n_gaps", "missing_steps", "n_outliers", "n_spikes"]
    return (
        out.fillna(0, counts)
        .withColumn("n_duplicates", F.col("n_rows_raw") - F.col("n_rows"))
        .withColumn("expected_rows", steps)
        .withColumn("coverage_pct", F.round(100.0 * F.col("n_rows") / F.greatest(steps, F.lit(1)), 2))
    )


def quality_flags(profile: DataFrame, declared: str | None = None, codes: Sequence[str] = ()) -> DataFrame:
    """Rows ``(series_id, flag, detail)`` from the profile."""
    def flag(name: str, when: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("flag"), detail.cast("string").alias("detail")))

    supported_ = supported("frequency")
    mismatch = F.lit(declared is not None) & ~F.col("frequency").eqNullSafe(F.lit(declared))
    not_midnight = (F.col("n_rows") > 24) & ((F.hour("start_ts") != 0) | (F.minute("start_ts") != 0))
    rules = [
        flag("LOAD_ERROR", F.col("n_missing") > 0.1 * F.col("n_rows"), F.lit("target coverage below 90 %")),
        flag("CATEGORICAL_CODE", F.lit(bool(codes)), F.lit(",".join(codes))),
        flag("FREQUENCY_MISMATCH", mismatch, F.coalesce("frequency", F.lit("unknown"))),
        flag("UNSUPPORTED_FREQUENCY", ~supported_, F.coalesce("frequency", F.lit("unknown"))),
        flag("DUPLICATES", F.col("n_duplicates") > 0, F.col("n_duplicates")),
        flag("LOW_COVERAGE", supported_ & (F.col("coverage_pct") < 90), F.round("coverage_pct", 2)),
        flag("GAPS", F.col("n_gaps") > 0, F.col("n_gaps")),
        flag("OUTLIERS", F.col("n_outliers") > 0, F.col("n_outliers")),
        flag("SPIKE", F.col("n_spikes") > 0, F.col("n_spikes")),
        flag("LOW_DIURNAL_VARIATION", F.round("hourly_ratio", 4) < WEAK_DIURNAL, F.lit("peak/trough below 1.05")),
        flag("MISSING_VALUES", F.col("n_missing") > 0, F.col("n_missing")),
        flag("NEGATIVE_TARGET", F.col("n_negative") > 0, F.col("n_negative")),
        flag("POSSIBLE_UTC", not_midnight, F.date_format("start_ts", "HH:mm")),
        flag("DST_MERGE_RISK", not_midnight & (F.col("n_dst_months") > 0), F.lit("March or November")),
    ]
    return profile.select(SERIES, F.inline(F.array_compact(F.array(*rules))))


def readiness(profile: DataFrame, flags: DataFrame, lookback: int = 24, horizon: int = 6) -> DataFrame:
    """Verdict and length advice per series."""
    blocking = flags.where(F.col("flag").isin(*BLOCKING_FLAGS)).groupBy(SERIES).agg(
        F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("blocking")  # at most two flag names
    )
    need = lookback + horizon + SPARE_ROWS
    return profile.join(blocking, SERIES, "left").select(
        SERIES, "n_rows", F.coalesce("blocking", F.lit("")).alias("blocking"),
        F.col("blocking").isNull().alias("ready"),
        (F.col("n_rows") >= need).alias("long_enough"),
        (F.col("n_rows") < ADVISED_ROWS).alias("below_advised_rows"),
    )


def minimum_length(df: DataFrame, lookback: int, horizon: int, step_seconds: int = 3600) -> DataFrame:
    """Length rules per series; ``error`` routes it to the failures."""
    need = lookback + horizon + SPARE_ROWS
    d = df.groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_rows"))
    return d.select(
        SERIES, "n_rows",
        F.when(F.col("n_rows") < need, F.format_string("%d rows, %d needed", "n_rows", F.lit(need))).alias("error"),
        (F.col("n_rows") < ADVISED_ROWS).alias("below_advised_rows"),
        (F.col("n_rows") < WEEK_HOURS * 3600 // step_seconds).alias("short_context"),
        (F.col("n_rows") >= lookback).alias("context_covers_lookback"),
    )


def training_span(df: DataFrame, split: DataFrame) -> DataFrame:
    """Days of data (365 advised) and the share of rows that train (about 0.8)."""
    span = df.groupBy(SERIES).agg((F.datediff(F.max(TS), F.min(TS)) + 1).alias("span_days"))
    share = split.groupBy(SERIES).agg(F.avg((F.col("role") == "training").cast("double")).alias("train_share"))
    return span.join(share, SERIES).withColumn("short_span", F.col("span_days") < MIN_SPAN_DAYS).withColumn(
        "ratio_ok", F.abs(F.col("train_share") - 0.8) <= 0.05
    )


# -- checks of stored runs -------------------------------------------------------------------


def covariate_mismatch(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Covariates a run needs and the data lacks, and the other way round."""
    have = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    need = F.array_union(
        F.coalesce("past_covariates", F.array().cast("array<string>")),
        F.coalesce("future_covariates", F.array().cast("array<string>")),
    )
    return runs.select(
        "model_id",
        F.array_join(F.sort_array(F.array_except(need, have)), ",").alias("missing"),
        F.array_join(F.sort_array(F.array_except(have, need)), ",").alias("extra"),
    ).withColumn("error", (F.col("missing") != "") | (F.col("extra") != ""))


def training_overlap(runs: DataFrame, df: DataFrame) -> DataFrame:
    """Is the test range inside the training range with a similar row count?"""
    test = df.groupBy(SERIES).agg(
        F.min(TS).alias("test_start"), F.max(TS).alias("test_end"), F.count(F.lit(1)).alias("n_test")
    )
    inside = (F.col("test_start") >= F.col("train_start")) & (F.col("test_end") <= F.col("train_end"))
    alike = F.abs(F.col("n_test") - F.col("n_rows")) / F.greatest(F.col("n_rows"), F.lit(1)) <= 0.10
    return runs.join(test, SERIES).select("model_id", SERIES, "n_rows", "n_test", (inside & alike).alias("overlaps"))


def short_test(df: DataFrame, lookback: int, step_seconds: int) -> DataFrame:
    """Fewer than a week of scorable steps after the lookback?"""
    week = WEEK_HOURS * 3600 // step_seconds
    usable = F.count(F.lit(1)) - lookback
    return df.groupBy(SERIES).agg(usable.alias("usable_steps")).withColumn("short", F.col("usable_steps") < week)


def interpolated_targets(df: DataFrame, step_seconds: int) -> DataFrame:
    """Targets that scoring would have to fill: counted before filling."""
    g = regular_grid(df.select(SERIES, TS, LOAD), step_seconds)
    return g.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col(LOAD).isNull()).alias("n_to_fill")
    ).withColumn("warn", F.col("n_to_fill") > 0)


def overfitting(runs: DataFrame) -> DataFrame:
    """Validation CV-RMSE above twice the training one."""
    ratio = F.when(F.col("train_cv_rmse") > 0, F.col("cv_rmse") / F.col("train_cv_rmse"))
    return runs.select("model_id", "train_cv_rmse", "cv_rmse", ratio.alias("ratio")).withColumn(
        "overfit", F.coalesce(F.col("ratio") > OVERFIT_RATIO, F.lit(False))
    )


def config_warnings(runs: DataFrame) -> DataFrame:
    """Horizon beyond lookback; very long horizon at sub-hourly steps."""
    fine = F.col("frequency").isin(*[f for f, s in STEP_SECONDS.items() if s < 3600])
    return runs.select(
        "model_id",
        (F.col("horizon") > F.col("lookback")).alias("horizon_exceeds_lookback"),
        (fine & (F.col("horizon") > MAX_FINE_HORIZON)).alias("many_fine_steps"),
    )


def run_guardrails(runs: DataFrame, readings: DataFrame, step_seconds: int) -> DataFrame:
    """All checks of stored runs against the readings they are to be judged on, one row per run.

    Overlap with the training range, too few steps to score, targets to fill, readings between the steps, an overfitted
    run, odd settings and covariates that the readings lack. Nothing is refused: a report carries the row beside its figures.
    """
    want = runs.select("model_id", SERIES, "lookback")
    facts = readings.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_n")).join(interpolated_targets(readings, step_seconds), SERIES, "left")
    facts = facts.join(off_grid(readings, step_seconds).select(SERIES, "n_off_grid"), SERIES, "left")
    week = WEEK_HOURS * 3600 // step_seconds
    have = F.array(*[F.lit(c) for c in readings.columns])
    need = F.array_union(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("past_covariates", "future_covariates")])
    lacking = runs.select("model_id", F.array_join(F.sort_array(F.array_except(need, have)), ",").alias("missing_covariates"))
    per = want.join(facts, SERIES, "left").select(
        "model_id", SERIES, (F.col("_n") - F.col("lookback")).alias("usable_steps"), (F.col("_n") - F.col("lookback") < week).alias("short_test"), "n_to_fill", "n_off_grid"
    )
    for part in (training_overlap(runs, readings).select("model_id", "overlaps"), overfitting(runs).select("model_id", "overfit"), config_warnings(runs), lacking):
        per = per.join(part, "model_id", "left")
    return per

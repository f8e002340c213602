"""Exploration tables: statistics, profiles, heat maps, relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.blocks import LOAD, SERIES, TS, attach, exact_percentiles
from gridcast.functions.time import WEEKDAYS, add_seconds, epoch, season

# Bins of the relation curve,
# thresholds of the correlation labels.
BINS, STRONG, MODERATE, MIN_OVERLAP_ROWS = 24, 0.6, 0.3, 10


def column_stats(df: DataFrame, roles: dict[str, str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """One row per key and column: counts, moments, range and percentiles."""
    types = dict(df.dtypes)
    long = df.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), F.lit(types[c]).alias("type"), F.col(c).cast("double").alias("v"))
            for c, r in roles.items()
        ])),
    )
    group = [*keys, "column"]
    stats = long.groupBy(*group, "role", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("v").isNull()).alias("n_missing"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.count_if(F.col("v") < 0).alias("n_negative"), F.count_if(F.col("v") == 0).alias("n_zero"),
    ).withColumn("coverage_pct", F.round(100.0 * (F.col("n") - F.col("n_missing")) / F.greatest("n", F.lit(1)), 2))
    return stats.join(exact_percentiles(long, group, "v", {"p5": 0.05, "p95": 0.95}), group, "left")


def time_range(df: DataFrame, step_seconds: int) -> DataFrame:
    """Start, end, duplicates and row coverage of each series."""
    unique = df.groupBy(SERIES, TS).agg(F.count(F.lit(1)).alias("c"))
    return unique.groupBy(SERIES).agg(
        F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"),
        F.sum("c").alias("n_rows_raw"), F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("n_duplicates", F.col("n_rows_raw") - F.col("n_rows")).withColumn(
        "expected_rows", F.floor((epoch("end_ts") - epoch("start_ts")) / step_seconds) + 1
    ).withColumn("coverage_pct", F.round(100.0 * F.col("n_rows") / F.greatest("expected_rows", F.lit(1)), 2))


def seasonality(df: DataFrame) -> DataFrame:
    """Peak and trough hour and weekday by mean load (series of 48 rows or more)."""
    def extremes(bucket, name: str) -> DataFrame:
        m = df.where(F.col(LOAD).isNotNull()).groupBy(SERIES, bucket.alias("b")).agg(
            F.avg(LOAD).alias("m"), F.count(F.lit(1)).alias("c")
        )
        return m.groupBy(SERIES).agg(
            F.sum("c").alias("n"),
            F.max_by("b", F.struct("m", -F.col("b"))).alias(f"peak_{name}"),
            F.min_by("b", F.struct("m", "b")).alias(f"trough_{name}"),
            (F.max("m") / F.greatest(F.min("m"), F.lit(1e-9))).alias(f"{name}_ratio"),
        )

    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    d = extremes(F.hour(TS), "hour").join(extremes(F.weekday(TS), "day").drop("n"), SERIES).where("n >= 48")
    return d.withColumns({"peak_day": names[F.col("peak_day")], "trough_day": names[F.col("trough_day")]}).withColumn(
        "low_diurnal_variation", F.round("hour_ratio", 4) < 1.05
    )


def covariate_correlation(df: DataFrame, covariates: Sequence[str], roles: dict[str, str] | None = None) -> DataFrame:
    """Pearson r of the load with every covariate, strongest first per series."""
    both = {c: F.when(F.col(LOAD).isNotNull() & F.col(c).isNotNull(), 1) for c in covariates}
    wide = df.groupBy(SERIES).agg(*[F.struct(F.corr(LOAD, c).alias("r"), F.count(both[c]).alias("n")).alias(c) for c in covariates])
    roles = roles or {}
    long = wide.select(
        SERIES,
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(roles.get(c, "past_covariate")).alias("role"),
                     F.col(f"{c}.r").alias("pearson_r"), F.col(f"{c}.n").alias("n_overlap_rows")) for c in covariates
        ])),
    ).where(F.col("n_overlap_rows") >= MIN_OVERLAP_ROWS)
    a = F.abs("pearson_r")
    w = Window.partitionBy(SERIES).orderBy(a.desc_nulls_last(), "column")  # one row per covariate
    return long.withColumn("abs_pearson_r", a).withColumn(
        "interpretation", F.when(a >= STRONG, "strong").when(a >= MODERATE, "moderate").otherwise("weak")
    ).withColumn("rank", F.row_number().over(w))


def load_profiles(df: DataFrame) -> DataFrame:
    """Mean, quartiles and count by hour, season and hour, weekday or weekend
    and hour, weekday, and month.

    Every row is expanded once per grouping, as GROUPING SETS would; the
    quartiles are exact without gathering a group.
    """
    h, d, m = F.hour(TS), F.weekday(TS), F.month(TS)
    def entry(profile, part, bucket):
        return F.struct(profile.alias("profile"), part.alias("part"), bucket.cast("int").alias("bucket"))

    expanded = df.where(F.col(LOAD).isNotNull()).select(
        SERIES, F.col(LOAD).alias("v"),
        F.inline(F.array(
            entry(F.lit("hour_of_day"), F.lit("all"), h),
            entry(F.lit("hour_of_day_by_season"), season(TS), h),
            entry(F.when(d >= 5, "hour_of_day_weekend").otherwise("hour_of_day_weekday"), F.lit("all"), h),
            entry(F.lit("day_of_week"), F.lit("all"), d),
            entry(F.lit("month"), F.lit("all"), m),
        )),
    )
    keys = [SERIES, "profile", "part", "bucket"]
    means = expanded.groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    return means.join(exact_percentiles(expanded, keys, "v", {"p25": 0.25, "p75": 0.75}), keys)


def heat_map(df: DataFrame) -> DataFrame:
    """Mean load per day and hour."""
    return df.where(F.col(LOAD).isNotNull()).groupBy(
        SERIES, F.to_date(TS).alias("date"), F.hour(TS).alias("hour")
    ).agg(F.avg(LOAD).alias("mean"))


def _pairs(df: DataFrame, covariate: str) -> DataFrame:
    return df.where(F.col(covariate).isNotNull() & F.col(LOAD).isNotNull()).select(
        SERIES, TS, F.col(covariate).cast("double").alias("x"), F.col(LOAD).alias("y")
    )


def relation_curve(df: DataFrame, covariate: str, bins: int = BINS) -> DataFrame:
    """Load against a covariate in equal-width bins, right edge included.

    Empty for a series with fewer than three pairs or without variance.
    """
    both = _pairs(df, covariate)
    span = both.groupBy(SERIES).agg(
        F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("x").alias("_sx"), F.stddev_samp("y").alias("_sy"),
    ).where("_n >= 3 and _sx > 0 and _sy > 0")
    width = (F.col("_hi") - F.col("_lo")) / bins
    d = attach(both, span, [SERIES]).withColumn(
        "bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((F.col("x") - F.col("_lo")) / width) - 1)).cast("int")
    )
    mid = F.col("_lo") + (F.col("bin") + 0.5) * width
    keys = [SERIES, "bin"]
    means = d.withColumn("_mid", mid).groupBy(*keys).agg(
        F.max("_mid").alias("x_mid"), F.avg("y").alias("mean"), F.count("y").alias("n")
    )
    return means.join(exact_percentiles(d, keys, "y", {"p25": 0.25, "p75": 0.75}), keys)


def scatter_sample(df: DataFrame, covariate: str, size: int, seed: int = 0) -> DataFrame:
    """At most ``size`` seeded rows per series; the same rows on every run.

    Ranks are taken inside hash parts first, so at most ``size`` rows per part
    reach the final rank of a series.
    """
    d = _pairs(df, covariate).withColumn("_k", F.xxhash64(SERIES, TS, F.lit(seed)))
    part = F.pmod(F.xxhash64("_k"), F.lit(64))
    inner = Window.partitionBy(SERIES, part).orderBy("_k", TS)
    outer = Window.partitionBy(SERIES).orderBy("_k", TS)
    return (
        d.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= size)
        .withColumn("_r", F.row_number().over(outer)).where(F.col("_r") <= size)
        .select(SERIES, TS, "x", "y", F.hour(TS).alias("hour"))
    )


def peak_windows(df: DataFrame, days_before: int = 3, days_after: int = 4) -> DataFrame:
    """Per season: its peak and the week around it, clipped to the data."""
    known = df.where(F.col(LOAD).isNotNull())
    per = known.groupBy(SERIES, season(TS).alias("season")).agg(
        F.max_by(TS, F.struct(F.col(LOAD), -epoch(TS))).alias("peak_ts"), F.max(LOAD).alias("peak_value"),
        F.min(TS).alias("_a"), F.max(TS).alias("_b"),
    )
    whole = Window.partitionBy(SERIES)  # four rows per series
    return per.select(
        SERIES, "season", "peak_ts", "peak_value",
        F.greatest(F.min("_a").over(whole), add_seconds("peak_ts", -days_before * 86400)).alias("start_ts"),
        F.least(F.max("_b").over(whole), add_seconds("peak_ts", days_after * 86400)).alias("end_ts"),
    )

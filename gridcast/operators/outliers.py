"""Value outliers, step-change spikes and thinning for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.blocks import BLK, LOAD, SERIES, TS, attach, row_index, with_summary, in_block
from gridcast.operators.grid import ensure_blocked

# Sigma multiple, least rows, floor of a meaningful step.
SIGMA, MIN_ROWS, MIN_SHARE, MIN_STEP = 3.0, 10, 0.01, 1e-6


def value_outliers(df: DataFrame) -> DataFrame:
    """Rows further than three standard deviations from the series mean."""
    known = df.where(F.col(LOAD).isNotNull()).select(SERIES, TS, LOAD)
    stats = known.groupBy(SERIES).agg(
        F.avg(LOAD).alias("mean"), F.stddev_samp(LOAD).alias("std"), F.count(LOAD).alias("n_known")
    ).where(F.col("n_known") >= MIN_ROWS)
    d = attach(known, stats, [SERIES])
    return d.where((F.col("std") > 0) & (F.abs(F.col(LOAD) - F.col("mean")) > SIGMA * F.col("std"))).select(
        SERIES, TS, LOAD,
        (F.col("mean") - SIGMA * F.col("std")).alias("threshold_low"),
        (F.col("mean") + SIGMA * F.col("std")).alias("threshold_high"),
        "n_known",
    )


def steps(df: DataFrame, step_seconds: int) -> DataFrame:
    """Signed difference to the previous known value."""
    known = ensure_blocked(df, step_seconds).where(F.col(LOAD).isNotNull()).select(SERIES, BLK, TS, LOAD)
    d = with_summary(
        known,
        [F.max(TS).alias("_t"), F.max_by(LOAD, TS).alias("_v")],
        lambda before, after, whole: [F.last("_v", True).over(before).alias("_carry")],
    )
    before = F.coalesce(F.lag(LOAD).over(in_block()), F.col("_carry"))
    return d.withColumn("value_before", before).withColumn("step", F.col(LOAD) - F.col("value_before")).drop("_carry")


def spikes(df: DataFrame, step_seconds: int) -> DataFrame:
    """Steps beyond three standard deviations of the absolute steps.

    Nothing is reported when that threshold is below 1 % of the mean load: on a
    flat series every step would count.
    """
    d = steps(df, step_seconds)
    stats = d.groupBy(SERIES).agg(
        (SIGMA * F.stddev_samp(F.abs("step"))).alias("threshold"),
        F.greatest(F.abs(F.avg(LOAD)) * MIN_SHARE, F.lit(MIN_STEP)).alias("_least"),
        F.count(LOAD).alias("n_known"),
        F.count("step").alias("n_steps"),
    ).where((F.col("n_known") >= MIN_ROWS) & (F.col("threshold") >= F.col("_least")))
    return (
        attach(d, stats, [SERIES])
        .where(F.abs("step") > F.col("threshold"))
        .select(SERIES, TS, LOAD, "value_before", "step", "threshold", "n_steps")
    )


def top_by(df: DataFrame, size, k: int = 5) -> DataFrame:
    """The ``k`` largest rows per series; ranks are cut per task first."""
    w = Window.partitionBy(SERIES).orderBy(size.desc(), TS)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def thin(df: DataFrame, step_seconds: int, max_points: int) -> DataFrame:
    """Every ceil(n / max_points)-th row of each series, for plots."""
    d = row_index(ensure_blocked(df, step_seconds), "idx", "n_rows")
    stride = F.ceil(F.col("n_rows") / max_points)
    return d.where(F.col("idx") % stride == 0).drop(BLK)

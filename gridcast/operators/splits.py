"""Train/validation splits and their segments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.blocks import BLK, SERIES, TS, in_block, number_runs, row_index, with_summary
from gridcast.functions.time import SEASONS, epoch, season
from gridcast.operators.grid import ensure_blocked


def sequential_split(df: DataFrame, step_seconds: int, validation: float = 0.2) -> DataFrame:
    """``role``: the first ``floor(n * (1 - validation))`` rows train."""
    d = row_index(ensure_blocked(df, step_seconds), "idx", "n_rows")
    cut = F.floor(F.col("n_rows") * F.lit(1 - validation))
    return d.withColumn("role", F.when(F.col("idx") < cut, "training").otherwise("validation")).withColumn(
        "strategy", F.lit("sequential")
    )


def seasonal_split(df: DataFrame, step_seconds: int, validation: float = 0.2) -> DataFrame:
    """``role`` with the last part of every season held out.

    Seasons pool all years, so within one calendar year the held-out winter is
    late December. A series that lacks a season, or where a part would be
    empty, falls back to the sequential rule. Season and series positions come
    from the same block summaries: one shuffle of the rows.
    """
    d = ensure_blocked(df, step_seconds).withColumn("season", season(TS))
    d = with_summary(
        d,
        [F.count_if(F.col("season") == s).alias(f"_c_{s}") for s in SEASONS],
        lambda before, after, whole: [
            *[F.coalesce(F.sum(f"_c_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in SEASONS],
            *[F.sum(f"_c_{s}").over(whole).alias(f"_n_{s}") for s in SEASONS],
        ],
    )
    keep = F.lit(1 - validation)

    def pick(prefix: str) -> Column:
        out = F.col(f"{prefix}{SEASONS[0]}")
        for s in SEASONS[1:]:
            out = F.when(F.col("season") == s, F.col(f"{prefix}{s}")).otherwise(out)
        return out

    def total(prefix: str) -> Column:
        return sum((F.col(f"{prefix}{s}") for s in SEASONS[1:]), F.col(f"{prefix}{SEASONS[0]}"))

    usable = F.lit(True)
    for s in SEASONS:
        cut = F.floor(F.col(f"_n_{s}") * keep)
        usable = usable & (cut > 0) & (cut < F.col(f"_n_{s}"))
    by_season = Window.partitionBy(SERIES, BLK, "season").orderBy(TS)
    season_idx = pick("_b_") + F.row_number().over(by_season) - 1
    idx = total("_b_") + F.row_number().over(in_block()) - 1
    trains = F.when(usable, season_idx < F.floor(pick("_n_") * keep)).otherwise(idx < F.floor(total("_n_") * keep))
    return (
        d.withColumn("role", F.when(trains, "training").otherwise("validation"))
        .withColumn("strategy", F.when(usable, "seasonal").otherwise("sequential"))
        .drop(*[f"_b_{s}" for s in SEASONS], *[f"_n_{s}" for s in SEASONS])
    )


def islands(df: DataFrame, step_seconds: int, labels: Sequence[str]) -> DataFrame:
    """Add ``island``: a new one where a label changes or a gap exceeds 1.5 steps."""
    def breaks(before, now):
        new = epoch(now[TS]) - epoch(before[TS]) > 1.5 * step_seconds
        for c in labels:
            new = new | ~before[c].eqNullSafe(now[c])
        return new

    return number_runs(ensure_blocked(df, step_seconds), [TS, *labels], breaks, "island")


def segments(df: DataFrame, step_seconds: int, label_seasons: bool = True) -> DataFrame:
    """Ordered runs of equal role (and season) with start, end and row count."""
    labels = ["role", "season"] if label_seasons else ["role"]
    d = df if "season" in df.columns else df.withColumn("season", season(TS))
    if not label_seasons:
        d = d.withColumn("season", F.lit(None).cast("string"))
    return islands(d, step_seconds, labels).groupBy(SERIES, "island").agg(
        F.first("role").alias("role"), F.first("season").alias("season"),
        F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"), F.count(F.lit(1)).alias("n_rows"),
    )


def season_spans(df: DataFrame, step_seconds: int) -> DataFrame:
    """Runs of one season, whatever the gaps inside them."""
    d = number_runs(
        ensure_blocked(df.withColumn("season", season(TS)), step_seconds), ["season"],
        lambda before, now: before["season"] != now["season"], "span",
    )
    return d.groupBy(SERIES, "span", "season").agg(F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"))


def segment_summary(segs: DataFrame) -> DataFrame:
    """Rows per role, overall and per season, and the validation share."""
    counts = segs.groupBy(SERIES, F.coalesce("season", F.lit("all")).alias("season")).pivot(
        "role", ["training", "validation"]
    ).agg(F.sum("n_rows")).fillna(0, ["training", "validation"])
    whole = counts.groupBy(SERIES).agg(
        F.lit("total").alias("season"), F.sum("training").alias("training"), F.sum("validation").alias("validation")
    )
    return counts.unionByName(whole).withColumn(
        "validation_fraction", F.round(F.col("validation") / (F.col("training") + F.col("validation")), 4)
    )


def role_codes(split: DataFrame) -> DataFrame:
    """0 for training, 1 for validation, -1 for rows in neither part."""
    code = F.when(F.col("role") == "training", 0).when(F.col("role") == "validation", 1).otherwise(-1)
    return split.withColumn("role_code", code)


def prepare_training(
    df: DataFrame,
    step_seconds: int,
    multi_series: bool = True,
    validation: float = 0.2,
    hook: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Split by the strategy the learner can use, and describe the result.

    Learners that accept several chunks get the seasonal split, each
    gap-free run of a part being one ``chunk_id``; others the sequential one.
    ``hook`` may change training rows before anything is fitted on them.
    """
    rule = seasonal_split if multi_series else sequential_split
    d = rule(df, step_seconds, validation)
    if hook is not None:
        d = hook(d.where("role = 'training'")).unionByName(d.where("role = 'validation'"), allowMissingColumns=True)
        d = ensure_blocked(d.drop(BLK), step_seconds)
    d = islands(d, step_seconds, ["role"]).withColumnRenamed("island", "chunk_id")
    filled = F.count_if("interpolated") if "interpolated" in d.columns else F.lit(0)
    summary = d.groupBy(SERIES, "role").agg(
        F.first("strategy").alias("strategy"),
        F.count(F.lit(1)).alias("n_steps"),
        filled.cast("long").alias("n_interpolated"),
    )
    # distinct chunks are counted in two steps: rows combine per chunk first
    n_chunks = d.groupBy(SERIES, "role", "chunk_id").agg(F.lit(1).alias("one")).groupBy(SERIES, "role").agg(
        F.count("one").alias("n_chunks")
    )
    return d, summary.join(n_chunks, [SERIES, "role"])

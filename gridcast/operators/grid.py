"""Regular grid, gap filling, gap reports and contiguous chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.blocks import (
    BLK, LOAD, SERIES, TS, block_of, block_seconds, blocked, nearest_known, number_runs, present, previous_ts,
)
from gridcast.functions.time import epoch, from_epoch


def regular_grid(df: DataFrame, step_seconds: int, order: str | None = None) -> DataFrame:
    """Insert the missing times between first and last reading of each series.

    Result rows carry ``_blk`` and are already hashed by ``(series_id, _blk)``,
    so the fills that follow need no further shuffle of the rows. Grid points
    are generated per block, never per series. Of readings at one time the row that comes first by ``order`` stays, by
    default that with the smallest known values, whole; readings between the steps are left out and counted by :func:`off_grid`.
    """
    length = block_seconds(step_seconds)
    values = [c for c in df.columns if c not in (SERIES, TS, BLK, order)]
    carried = values if order is None else [*values, order]
    e = epoch(TS)
    df = df.where(present(SERIES, TS))
    # counting the values keeps this branch on the exchange the rows come from
    seen = sum((F.count(c) for c in values), F.lit(0))
    bounds = df.groupBy(SERIES).agg(F.min(e).alias("_lo"), F.max(e).alias("_hi"), seen.alias("_seen")).where("_seen >= 0")
    spans = bounds.withColumn(
        BLK, F.explode(F.sequence(block_of(F.col("_lo"), length), block_of(F.col("_hi"), length)))
    ).repartition(SERIES, BLK)
    first = F.ceil(F.greatest(F.lit(0), F.col(BLK) * length - F.col("_lo")) / step_seconds)
    last = F.floor((F.least(F.col("_hi"), (F.col(BLK) + 1) * length - 1) - F.col("_lo")) / step_seconds)
    points = spans.select(
        SERIES, BLK, "_lo",
        F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("_k"),
    ).select(
        SERIES, BLK, from_epoch(F.col("_lo") + F.col("_k") * step_seconds).alias(TS),
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in carried], F.lit(True).alias("_grid"),
    )
    readings = df.select(
        SERIES, block_of(e, length).alias(BLK), TS, *carried, F.lit(False).alias("_grid")
    )
    per_time = points.unionByName(readings).repartition(SERIES, BLK).groupBy(SERIES, BLK, TS)
    if order is not None:  # rows of the grid have no order and give way to any reading
        rows = per_time.agg(F.min_by(F.struct(*values), order).alias("_row"), F.max("_grid").alias("_grid")).where("_grid")
        return rows.select(SERIES, BLK, TS, *[F.col("_row")[c].alias(c) for c in values])
    if len(values) < 2:
        return per_time.agg(*[F.min(c).alias(c) for c in values], F.max("_grid").alias("_grid")).where("_grid").drop("_grid")
    ranked = F.struct(*[x for c in values for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))])
    rows = per_time.agg(F.min(ranked).alias("_row"), F.max("_grid").alias("_grid")).where("_grid")
    return rows.select(SERIES, BLK, TS, *[F.col("_row")[c].alias(c) for c in values])


def off_grid(df: DataFrame, step_seconds: int) -> DataFrame:
    """Per series the readings, and how many of them lie between the steps counted from the first one."""
    e = epoch(TS)
    phases = df.where(present(SERIES, TS)).groupBy(SERIES, F.pmod(e, F.lit(step_seconds)).alias("_p")).agg(
        F.count(F.lit(1)).alias("n"), F.min(e).alias("_lo")
    )
    return phases.groupBy(SERIES).agg(
        F.sum("n").alias("n_readings"), (F.sum("n") - F.min_by("n", "_lo")).alias("n_off_grid")
    )


def ensure_blocked(df: DataFrame, step_seconds: int) -> DataFrame:
    return df if BLK in df.columns else blocked(df, block_seconds(step_seconds))


def interpolate(
    df: DataFrame,
    step_seconds: int,
    value: str = LOAD,
    max_gap_seconds: int | None = None,
    head: bool = False,
) -> DataFrame:
    """Time-weighted linear filling of NULLs.

    Leading NULLs stay unless ``head``; trailing NULLs take the last known
    value; a hole whose known neighbours lie further apart than
    ``max_gap_seconds`` is left alone. ``interpolated`` marks filled rows.
    """
    d = nearest_known(ensure_blocked(df, step_seconds), value)
    t, p, n = epoch(TS), epoch("_pt"), epoch("_nt")
    line = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (t - p) / (n - p)
    inner = F.col("_pt").isNotNull() & F.col("_nt").isNotNull()
    if max_gap_seconds is not None:
        inner_fill = F.when(n - p <= max_gap_seconds, line)
    else:
        inner_fill = line
    edge = F.coalesce("_pv", "_nv") if head else F.col("_pv")
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(inner, inner_fill).otherwise(edge)
    was_null = F.col(value).isNull()
    return (
        d.withColumn("_f", filled)
        .withColumn("interpolated", was_null & F.col("_f").isNotNull())
        .withColumn(value, F.col("_f"))
        .drop("_f", "_pt", "_pv", "_nt", "_nv")
    )


def fill_all(df: DataFrame, step_seconds: int, value: str = LOAD) -> DataFrame:
    """Fill in both directions, so no NULL stays in a series with any value."""
    return interpolate(df, step_seconds, value, head=True)


def gaps(df: DataFrame, step_seconds: int) -> DataFrame:
    """Every jump longer than 1.5 steps, with both ends."""
    d = previous_ts(ensure_blocked(df, step_seconds))
    delta = epoch(TS) - epoch("prev_ts")
    return d.where(delta > 1.5 * step_seconds).select(
        SERIES,
        F.col("prev_ts").alias("last_before"),
        F.col(TS).alias("first_after"),
        (F.round(delta / step_seconds) - 1).cast("long").alias("missing_steps"),
        (delta / 3600).alias("hours"),
    )


def gap_summary(df: DataFrame, step_seconds: int, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Totals per series, and its ``top`` longest gaps.

    The rank filter is applied per task before the shuffle, so only ``top``
    rows per series and task travel.
    """
    g = gaps(df, step_seconds)
    totals = g.groupBy(SERIES).agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.sum("missing_steps").alias("total_missing_steps"),
        F.max("hours").alias("largest_gap_hours"),
        F.max_by("first_after", F.struct("hours", -epoch("first_after"))).alias("largest_gap_start"),
    )
    w = Window.partitionBy(SERIES).orderBy(F.desc("hours"), "first_after")
    longest = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return totals, longest


def chunks(df: DataFrame, step_seconds: int) -> DataFrame:
    """Add ``chunk_id``: 0-based number of the gap-free run a row lies in."""
    return number_runs(
        ensure_blocked(df, step_seconds), [TS],
        lambda before, now: epoch(now[TS]) - epoch(before[TS]) > step_seconds, "chunk_id",
    )


def chunk_spans(df: DataFrame, step_seconds: int) -> DataFrame:
    """One row per chunk: first and last time and row count."""
    return (
        chunks(df, step_seconds)
        .groupBy(SERIES, "chunk_id")
        .agg(F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"), F.count(F.lit(1)).alias("n_rows"))
    )

"""Joining weather and other covariates to load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import BLK, LOAD, SERIES, TS, attach, block_of, block_seconds, blocked, from_here, up_to_here, with_summary
from gridcast.functions.time import add_seconds, epoch
from gridcast.sources.catalog import median_gap
from gridcast.sources.readings import DataLoadError

# Limits of the merge checks.
MIN_OVERLAP, WARN_FILL, STOP_FILL = 0.95, 0.05, 0.20
FILL_BLOCK_SECONDS = 86400 * 32


def convert_clock(df: DataFrame, source: str, target: str, ts: str = TS) -> DataFrame:
    """Move a wall clock from one zone to another.

    ``clock_issue`` names source times that do not exist or occur twice in the
    source zone; Spark resolves them silently, so a round trip finds them.
    """
    def there(c: Column) -> Column:
        return F.convert_timezone(F.lit(source), F.lit("UTC"), c)

    def back(c: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(source), c)

    utc = there(F.col(ts))
    issue = (
        F.when(back(utc) != F.col(ts), "nonexistent")
        .when((back(add_seconds(utc, 3600)) == F.col(ts)) | (back(add_seconds(utc, -3600)) == F.col(ts)), "ambiguous")
    )
    return df.withColumn("source_ts", F.col(ts)).withColumn("clock_issue", issue).withColumn(
        ts, F.convert_timezone(F.lit(source), F.lit(target), F.col("source_ts"))
    )


def unique_times(cov: DataFrame, order: str = "source_ts") -> DataFrame:
    """One covariate row per time (and series): the first by ``order``, which
    may be one of the covariates.

    ``n_copies`` tells how many rows shared the time. Combined before the
    shuffle.
    """
    keys = [c for c in (SERIES, TS) if c in cov.columns]
    rest = [c for c in cov.columns if c not in (*keys, "source_ts")]
    return cov.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in rest], F.count(F.lit(1)).alias("n_copies")
    )


def merge_covariates(load: DataFrame, cov: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Left join on time (and series where the covariate has one).

    All load rows stay. A covariate shared by all series is joined on time
    with the load rows of one time spread over salts. ``cov`` must hold one
    row per key (:func:`unique_times`).
    """
    keys = [c for c in (SERIES, TS) if c in cov.columns]
    columns = list(columns) if columns is not None else [c for c in cov.columns if c not in (*keys, "n_copies", "source_ts", "clock_issue")]
    unknown = [c for c in columns if c not in cov.columns]
    if unknown:
        raise DataLoadError(f"unknown covariate columns: {unknown}")
    clash = [c for c in columns if c in load.columns]
    if clash:
        raise DataLoadError(f"columns on both sides: {clash}")
    picked = cov.select(*keys, *columns)
    if keys == [TS]:
        return attach(load, picked, [TS], "left")
    return load.join(picked, keys, "left")


def merge_by_block(load: DataFrame, cov: DataFrame, step_seconds: int, columns: Sequence[str]) -> DataFrame:
    """Left join of a covariate that all series share, without moving the load rows once they lie by time block.

    The covariate becomes one row per time block with a map from time to values; each (series, block) of the load
    takes its block's map and each row looks its time up. ``cov`` must hold one row per time (:func:`unique_times`).
    """
    unknown = [c for c in columns if c not in cov.columns]
    if unknown:
        raise DataLoadError(f"unknown covariate columns: {unknown}")
    length = block_seconds(step_seconds)
    d = load if BLK in load.columns else blocked(load, length)
    maps = cov.where(F.col(TS).isNotNull()).groupBy(block_of(epoch(TS), length).alias(BLK)).agg(
        F.map_from_entries(F.collect_list(F.struct(TS, F.struct(*columns)))).alias("_cov")
    )
    blocks = d.groupBy(SERIES, BLK).agg(F.lit(1).alias("_one")).drop("_one")
    met = d.join(blocks.join(maps, BLK).select(SERIES, BLK, "_cov"), [SERIES, BLK], "left")
    return met.withColumn("_at", F.col("_cov")[F.col(TS)]).select(*d.columns, *[F.col("_at")[c].alias(c) for c in columns])


def fill_covariates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Carry the last known value forward, then the first one back.

    ``was_missing`` marks rows where any column had to be filled. All columns
    share one pass over the blocks.
    """
    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(TS))

    d = df if BLK in df.columns else blocked(df, FILL_BLOCK_SECONDS)
    aggs, outs = [], []
    for c in columns:
        aggs += [F.max_by(c, known(c)).alias(f"_l_{c}"), F.min_by(c, known(c)).alias(f"_f_{c}")]
        outs.append(c)
    d = with_summary(
        d, aggs,
        lambda before, after, whole: [
            e for c in outs for e in (
                F.last(f"_l_{c}", True).over(before).alias(f"_p_{c}"),
                F.last(f"_f_{c}", True).over(after).alias(f"_n_{c}"),
            )
        ],
    )
    missing = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
    filled = {
        c: F.coalesce(
            F.last(c, True).over(up_to_here()), F.col(f"_p_{c}"),
            F.last(c, True).over(from_here()), F.col(f"_n_{c}"),
        )
        for c in columns
    }
    rest = [c for c in df.columns if c not in columns]
    return d.select(*rest, *[e.alias(c) for c, e in filled.items()], missing.alias("was_missing"))


def merge_report(load: DataFrame, cov: DataFrame, columns: Sequence[str], name: str, converted: bool = False) -> DataFrame:
    """Checks of one merge: overlap, cadence, share filled, duplicates, verdict."""
    keys = [c for c in (SERIES, TS) if c in cov.columns]
    n_dup = cov.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("v"))
    base = load.select(SERIES, TS)
    order = "source_ts" if "source_ts" in cov.columns else columns[0]
    joined = merge_covariates(base, unique_times(cov, order), columns)
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    counts = joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null).alias("n_missing_filled"),
        F.min(TS).alias("load_start"), F.max(TS).alias("load_end"),
    )
    span = cov.agg(F.min(TS).alias("s"), F.max(TS).alias("e"))

    def gap(df: DataFrame, keys: list[str]) -> DataFrame:
        g = median_gap(df.select(*keys, TS), keys) if keys else median_gap(df.select(F.lit(0).alias("k"), TS), ["k"])
        return g.agg(F.min("median_gap_s"))

    n_years = (epoch("load_end") - epoch("load_start")) / (365.25 * 86400)
    overlap = (
        F.least(epoch("load_end"), epoch("cov_end")) - F.greatest(epoch("load_start"), epoch("cov_start"))
    ) / (epoch("load_end") - epoch("load_start"))
    r = counts.select(
        F.lit(name).alias("covariate"), "*",
        n_dup.scalar().alias("duplicates_dropped"),
        span.select("s").scalar().alias("cov_start"), span.select("e").scalar().alias("cov_end"),
        gap(load, [SERIES]).scalar().alias("load_gap_s"),
        gap(cov, [SERIES] if SERIES in cov.columns else []).scalar().alias("cov_gap_s"),
    ).withColumn("overlap", overlap).withColumn("fill_share", F.col("n_missing_filled") / F.col("n_rows"))
    too_fine = F.col("cov_gap_s") < F.col("load_gap_s")
    dup = F.col("duplicates_dropped")
    stop = (
        F.when(too_fine, "finer than load")
        .when(F.lit(not converted) & (dup > 0), "duplicate times")
        .when(F.col("fill_share") > STOP_FILL, "fill share above 20 %")
    )
    warnings = F.array_compact(F.array(
        F.when(F.col("cov_gap_s") > F.col("load_gap_s"), "coarser than load"),
        F.when(F.col("overlap") < MIN_OVERLAP, "overlap below 95 %"),
        F.when(F.col("fill_share") > WARN_FILL, "fill share above 5 %"),
        F.when(F.lit(converted) & (dup > 4 * F.greatest(F.lit(1.0), n_years)), "many repeated local times"),
    ))
    return r.select(
        "covariate", "n_rows", "n_missing_filled", "fill_share", "duplicates_dropped",
        "overlap", "load_gap_s", "cov_gap_s",
        F.concat_ws("; ", warnings).alias("warnings"),
        F.when(stop.isNotNull(), "stop").when(F.size(warnings) > 0, "warn").otherwise("ok").alias("verdict"),
        stop.alias("stop_reason"),
    )


def merge_all(load: DataFrame, covs: dict[str, tuple[DataFrame, Sequence[str]]]) -> tuple[DataFrame, DataFrame]:
    """Fold several covariates into load; returns the rows and one report row each."""
    seen: set[str] = set(load.columns)
    for name, (_, columns) in covs.items():
        clash = seen & set(columns)
        if clash:
            raise DataLoadError(f"{name} repeats columns {sorted(clash)}")
        seen |= set(columns)
    out, report, added = load, None, []
    for name, (cov, columns) in covs.items():
        order = "source_ts" if "source_ts" in cov.columns else columns[0]
        line = merge_report(load, cov, columns, name, converted="source_ts" in cov.columns)
        report = line if report is None else report.unionByName(line)
        out = merge_covariates(out, unique_times(cov, order), columns)
        added += columns
    # fills are per column, so one pass over the blocks serves all covariates
    out = fill_covariates(out, added).drop("was_missing")
    return out, report


def clock_checks(df: DataFrame, columns: dict[str, tuple[int, int]], night: str | None = None) -> DataFrame:
    """Does each column peak in the hours it should?

    ``columns`` maps a column to the accepted range of its peak hour; ``night``
    names a radiation column whose mean must stay below 1 at 23:00..03:00. A
    shifted covariate clock fails here.
    """
    by_hour = df.groupBy(SERIES, F.hour(TS).alias("hour")).agg(*[F.avg(c).alias(c) for c in columns])
    long = by_hour.unpivot([SERIES, "hour"], list(columns), "column", "mean")
    peaks = long.groupBy(SERIES, "column").agg(
        F.max_by("hour", F.struct("mean", -F.col("hour"))).alias("peak_hour"),
        F.max(F.when(F.col("hour").isin(0, 1, 2, 3, 23), F.col("mean"))).alias("night_mean"),
    )
    lo, hi = F.lit(None).cast("int"), F.lit(None).cast("int")
    for c, (a, b) in columns.items():
        lo, hi = F.when(F.col("column") == c, a).otherwise(lo), F.when(F.col("column") == c, b).otherwise(hi)
    dark = (F.col("column") != F.lit(night or "")) | (F.col("night_mean") < 1.0)
    return peaks.withColumn("lo", lo).withColumn("hi", hi).withColumn(
        "aligned", F.col("peak_hour").between(F.col("lo"), F.col("hi")) & dark
    )


def clocks_agree(a: DataFrame, b: DataFrame, column: str, tolerance: int = 2) -> DataFrame:
    """Peak hour of a column in two tables, and whether they agree."""
    def peak(df: DataFrame, name: str) -> DataFrame:
        m = df.groupBy(SERIES, F.hour(TS).alias("hour")).agg(F.avg(column).alias("mean"))
        return m.groupBy(SERIES).agg(F.max_by("hour", F.struct("mean", -F.col("hour"))).alias(name))

    return peak(a, "peak_a").join(peak(b, "peak_b"), SERIES).withColumn(
        "agree", F.abs(F.col("peak_a") - F.col("peak_b")) <= tolerance
    )

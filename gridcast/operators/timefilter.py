"""Date windows, buffered windows, context/horizon and backtest starts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import BLK, LOAD, SERIES, TS, attach, row_index
from gridcast.functions.time import add_seconds, epoch
from gridcast.operators.features import LAG_HOURS, lag_features
from gridcast.operators.grid import ensure_blocked


class WindowError(ValueError):
    pass


def _ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _wall(text: str) -> datetime:
    try:
        value = datetime.fromisoformat(text)
    except ValueError as e:
        raise WindowError(f"not a date or time: {text!r}") from e
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


@dataclass(frozen=True)
class DateWindow:
    """Inclusive window; an end without a clock time means that whole day."""

    start: str | None = None
    end: str | None = None

    def __post_init__(self):
        lo, hi, inclusive = self.bounds()
        if lo and hi and (lo > hi if inclusive else lo >= hi):
            raise WindowError(f"empty window: {self.start} .. {self.end}")

    def bounds(self) -> tuple[datetime | None, datetime | None, bool]:
        lo = _wall(self.start) if self.start else None
        hi = _wall(self.end) if self.end else None
        inclusive = bool(self.end and re.search(r"\d{1,2}:\d{2}", self.end))
        if hi and not inclusive:
            hi = datetime(hi.year, hi.month, hi.day) + timedelta(days=1)
        return lo, hi, inclusive

    def predicate(self, ts: str = TS, history_seconds: int = 0) -> Column:
        lo, hi, inclusive = self.bounds()
        keep = F.lit(True)
        if lo:
            keep = keep & (F.col(ts) >= _ntz(lo - timedelta(seconds=history_seconds)))
        if hi:
            keep = keep & (F.col(ts) <= _ntz(hi) if inclusive else F.col(ts) < _ntz(hi))
        return keep


def filter_window(df: DataFrame, window: DateWindow) -> DataFrame:
    """A plain predicate on ``ts``; it reaches the Parquet scan."""
    return df.where(window.predicate())


def window_report(df: DataFrame, window: DateWindow) -> DataFrame:
    """Rows kept and left out per series, in one pass."""
    keep = F.coalesce(window.predicate(), F.lit(False))
    return df.groupBy(SERIES).agg(
        F.count_if(keep).alias("rows_in_window"),
        F.count_if(~keep).alias("rows_excluded"),
        F.min(F.when(keep, F.col(TS))).alias("first_kept"),
        F.max(F.when(keep, F.col(TS))).alias("last_kept"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
    )


def lags_in_window(
    df: DataFrame, window: DateWindow, step_seconds: int, lag_hours=LAG_HOURS
) -> DataFrame:
    """Lag features for a window, computed from real history before it.

    The first filter keeps the longest lag of history and is pushed into the
    scan; the second trims the result to the window.
    """
    early = df.where(window.predicate(history_seconds=max(lag_hours) * 3600))
    return filter_window(lag_features(early, step_seconds, lag_hours), window)


def context_horizon(df: DataFrame) -> DataFrame:
    """``part``: context up to the last known load, horizon after it."""
    last = df.groupBy(SERIES).agg(F.max(F.when(F.col(LOAD).isNotNull(), F.col(TS))).alias("last_known"))
    return attach(df, last, [SERIES]).withColumn(
        "part", F.when(F.col(TS) <= F.col("last_known"), "context").otherwise("horizon")
    )


def tail(df: DataFrame, days: int = 7) -> DataFrame:
    """Rows of the last days of each series."""
    last = df.groupBy(SERIES).agg(F.max(TS).alias("_max"))
    return attach(df, last, [SERIES]).where(F.col(TS) > add_seconds("_max", -days * 86400)).drop("_max")


def backtest_start(
    df: DataFrame,
    step_seconds: int,
    lookback: int,
    fraction: float | None = None,
    date: str | None = None,
    warmup_steps: int = 0,
) -> DataFrame:
    """First origin per series, as a row position and a time.

    By fraction: the later of the lookback and that share of the rows (0.2
    unless given). By date: the first row at or after it, which must leave the
    lag warm-up and the lookback before it; ``error`` names the earliest time
    otherwise. The two cannot be combined.
    """
    if fraction is not None and date is not None:
        raise ValueError("give a start fraction or a start date, not both")
    d = row_index(ensure_blocked(df, step_seconds).select(SERIES, BLK, TS), "idx", "n_rows")
    earliest = warmup_steps + lookback
    per = d.groupBy(SERIES).agg(
        F.max("n_rows").alias("n_rows"),
        F.max(F.when(F.col("idx") == earliest, F.col(TS))).alias("earliest_ts"),
        *(
            [F.min(F.when(F.col(TS) >= _ntz(_wall(date)), F.col("idx"))).alias("start_idx")]
            if date
            else []
        ),
    )
    if not date:
        share = F.floor(F.col("n_rows") * F.lit(0.2 if fraction is None else float(fraction)))
        per = per.withColumn("start_idx", F.greatest(F.lit(lookback).cast("long"), share))
    floor = earliest if date else lookback
    error = (
        F.when(F.col("n_rows") <= floor, F.lit("not enough data"))
        .when(F.col("start_idx").isNull(), F.lit("start is after the last reading"))
        .when(F.col("start_idx") < floor, F.concat(F.lit("earliest valid start is "), F.date_format("earliest_ts", "yyyy-MM-dd HH:mm:ss")))
    )
    per = per.withColumn("error", error)
    starts = per.join(
        d.select(SERIES, F.col("idx").alias("start_idx"), F.col(TS).alias("start_ts")),
        [SERIES, "start_idx"], "left",
    )
    return starts.select(SERIES, "n_rows", "start_idx", "start_ts", "earliest_ts", "error")

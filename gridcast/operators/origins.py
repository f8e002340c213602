"""Rolling forecast origins and supervised rows.

An origin is the time of the first forecast step; the history of an origin is
everything before it. Forecast rows are
``(series_id, model, origin_ts, h, ts, yhat)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.blocks import BLK, LOAD, SERIES, TS, block_seconds, haloed, row_index
from gridcast.functions.time import add_seconds
from gridcast.operators.grid import ensure_blocked

START_FRACTION = 0.2


def mark_origins(
    df: DataFrame,
    step_seconds: int,
    lookback: int,
    horizon: int,
    stride: int | None = None,
    start_fraction: float = START_FRACTION,
    starts: DataFrame | None = None,
    keep_rel: bool = False,
) -> DataFrame:
    """Grid rows with ``idx``, ``n_rows`` and ``is_origin`` (and ``rel``, the
    position after the first origin, if ``keep_rel``).

    The first origin is the later of the lookback and the start fraction, or
    ``start_idx`` of :func:`gridcast.operators.timefilter.backtest_start`;
    further ones follow every ``stride`` (default: the horizon) rows while a
    whole horizon fits.
    """
    d = row_index(ensure_blocked(df, step_seconds), "idx", "n_rows")
    if starts is None:
        start: Column = F.greatest(
            F.lit(lookback).cast("long"), F.floor(F.col("n_rows") * F.lit(float(start_fraction)))
        )
    else:
        # per-series starts reach the rows through their blocks, not through a hot key
        blocks = d.groupBy(SERIES, BLK).agg(F.lit(1).alias("_one")).drop("_one")
        per = blocks.join(starts.where("error is null").select(SERIES, "start_idx"), SERIES)
        d = d.join(per, [SERIES, BLK])
        start = F.col("start_idx")
    rel = F.col("idx") - start
    out = d.withColumn(
        "is_origin",
        (rel >= 0) & (rel % (stride or horizon) == 0) & (F.col("idx") + horizon <= F.col("n_rows")),
    )
    return (out.withColumn("rel", rel) if keep_rel else out).drop("start_idx")


def rolling_origins(df: DataFrame, step_seconds: int, lookback: int, horizon: int, **kwargs) -> DataFrame:
    """One row per origin: ``(series_id, origin_ts, origin_idx)``."""
    d = mark_origins(df, step_seconds, lookback, horizon, **kwargs)
    return d.where("is_origin").select(SERIES, F.col(TS).alias("origin_ts"), F.col("idx").alias("origin_idx"))


def over_horizon(origins: DataFrame, step_seconds: int, horizon: int, last_only: bool = False) -> DataFrame:
    """One row per origin and step ahead; ``last_only`` keeps the last step."""
    hs = F.array(F.lit(horizon)) if last_only else F.sequence(F.lit(1), F.lit(horizon))
    d = origins.withColumn("h", F.explode(hs))
    return d.withColumn(TS, add_seconds("origin_ts", (F.col("h") - 1) * step_seconds))


def _frame(lo: int, hi: int):
    return Window.partitionBy(SERIES, BLK).orderBy(TS).rowsBetween(lo, hi)


def supervised(
    df: DataFrame,
    step_seconds: int,
    lookback: int,
    horizon: int,
    past: Sequence[str] = (),
    future: Sequence[str] = (),
    static: Sequence[str] = (),
    target: str = LOAD,
    keep_open: bool = False,
) -> DataFrame:
    """Direct multi-step rows: features ``x`` and targets ``y`` per time.

    ``x`` = ``lookback`` target lags, the same lags of every past covariate,
    every future covariate over the horizon, and ``static`` columns at the
    origin (calendar of the target time). ``y`` = the next ``horizon`` targets.
    Windows reach into neighbouring blocks through halos and are dropped when
    they would leave a chunk (``chunk_id``, where present) or hold a NULL.
    ``keep_open`` keeps rows whose targets are not complete, as an origin at
    the end of the data needs. ``fit_ok`` is true where the targets are
    complete and, with a ``role`` column, the whole window lies in training
    rows: no target of the validation part leaks into a fit.
    """
    keep = [c for c in df.columns if c not in (BLK,)]
    reach = max(lookback, horizon)
    h = haloed(
        df.select(*keep), block_seconds(step_seconds, reach),
        before=lookback * step_seconds, after=horizon * step_seconds,
    )
    back, ahead = _frame(-lookback, -1), _frame(0, horizon - 1)
    parts = [F.collect_list(c).over(back) for c in (target, *past)]
    widths = [lookback] * (1 + len(past)) + [horizon] * len(future)
    parts += [F.collect_list(c).over(ahead) for c in future]
    names = [f"_x{i}" for i in range(len(parts))]
    d = h.withColumns(dict(zip(names, parts)))
    ok = F.col("_own")
    for n, w in zip(names, widths):
        ok = ok & (F.size(n) == w)
    w = Window.partitionBy(SERIES, BLK).orderBy(TS)
    d = d.withColumn("y", F.collect_list(target).over(ahead))
    whole = F.size("y") == horizon
    if "chunk_id" in keep:
        d = d.withColumn("_first", F.lag("chunk_id", lookback).over(w)).withColumn(
            "_last", F.lead("chunk_id", horizon - 1).over(w)
        )
        ok = ok & (F.col("_first") == F.col("chunk_id"))
        whole = whole & (F.col("_last") == F.col("chunk_id"))
    trains = whole
    if "role" in keep:
        d = d.withColumn(
            "_train", F.min((F.col("role") == "training").cast("int")).over(_frame(-lookback, horizon - 1))
        )
        trains = whole & (F.col("_train") == 1)
    d = d.withColumn("fit_ok", F.coalesce(trains, F.lit(False)))
    if not keep_open:
        ok = ok & whole
    x = F.concat(*[F.col(n) for n in names], *([F.array(*[F.col(c).cast("double") for c in static])] if static else []))
    extra = [c for c in ("idx", "n_rows", "is_origin", "role", "chunk_id", "season") if c in keep]
    return d.where(ok).select(SERIES, TS, *extra, "fit_ok", x.alias("x"), "y")

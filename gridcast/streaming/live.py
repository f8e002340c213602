"""Readings as a stream, and forecasts that follow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridcast.functions.blocks import LOAD, SERIES, TS, attach
from gridcast.functions.time import add_seconds, steps_per_day
from gridcast.operators.fleet import forward_forecast

UNTIL_USED_UP = {"availableNow": True}


def regular_load(stream: DataFrame, step: str = "1 hour", late: str = "2 hours", how: str = "sum") -> DataFrame:
    """Raw readings to one load per series and step; later readings than
    ``late`` behind the newest are dropped by the watermark.

    Partial sums per task keep the state at one row per series and open step.
    """
    agg = {"sum": F.sum, "avg": F.avg}[how](LOAD)
    return (
        stream.select(SERIES, F.col(TS).cast("timestamp").alias(TS), LOAD)  # watermarks need an instant; the session is UTC
        .withWatermark(TS, late)
        .groupBy(SERIES, F.window(TS, step).alias("w"))
        .agg(agg.alias(LOAD), F.count(F.lit(1)).alias("n_readings"))
        .select(SERIES, F.col("w.start").cast("timestamp_ntz").alias(TS), LOAD, "n_readings")
    )


def write_load(load: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append closed steps to a Parquet table; without a trigger (``{"processingTime": "1 minute"}``) stop when input is used up."""
    return (
        load.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or UNTIL_USED_UP)).start()
    )


def reach_steps(model: str, lookback: int, step_seconds: int) -> int | None:
    """Steps before the origin that a forward forecast depends on; None where it is all history (means, fits)."""
    return {"NaiveSeasonal": steps_per_day(step_seconds), "NaiveMovingAverage": lookback}.get(model)


def score_batch(
    batch: DataFrame, batch_id: int, table: str, out: str, step_seconds: int, horizon: int,
    lookback: int = 24, model: str = "NaiveSeasonal",
) -> None:
    """Forecast the series that received a step in this micro-batch.

    The batch is first added to the load table in a directory of its own; then
    the history of the touched series is read back as far as the model's forecast depends on it, with the last
    known reading before that for the filling of holes, and forecast. Both writes replace the directory of this batch, so a retried batch gives the
    same rows once per ``(series_id, origin_ts)``.
    """
    spark = batch.sparkSession
    batch.select(SERIES, TS, LOAD).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
    touched = batch.where(F.col(LOAD).isNotNull()).groupBy(SERIES).agg(F.max(TS).alias("_upto"))
    history = spark.read.parquet(table).where(F.col("batch") <= batch_id).select(SERIES, TS, LOAD)
    recent = attach(history, touched, [SERIES]).where(F.col(TS) <= F.col("_upto"))
    steps = reach_steps(model, lookback, step_seconds)
    if steps is not None:
        inside = F.col(TS) > add_seconds("_upto", -steps * step_seconds)
        before = recent.where(~inside & F.col(LOAD).isNotNull()).groupBy(SERIES).agg(F.max(TS).alias(TS), F.max_by(LOAD, TS).alias(LOAD))
        recent = recent.where(inside).select(SERIES, TS, LOAD).unionByName(before)
    recent = recent.groupBy(SERIES, TS).agg(F.max(LOAD).alias(LOAD))
    f = forward_forecast(recent, step_seconds, horizon, model, lookback)
    f.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def latest_forecasts(spark: SparkSession, out: str) -> DataFrame:
    """One forecast per series, origin and step, the newest batch winning."""
    f = spark.read.parquet(out)
    rest = [c for c in f.columns if c not in (SERIES, "origin_ts", "h", "batch")]
    return f.groupBy(SERIES, "origin_ts", "h").agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def follow(load: DataFrame, table: str, out: str, checkpoint: str, step_seconds: int, horizon: int, trigger: dict | None = None, **kwargs) -> StreamingQuery:
    """Run :func:`score_batch` on every micro-batch of a load stream; without a trigger stop when input is used up."""
    return (
        load.writeStream.outputMode("append")
        .foreachBatch(lambda b, i: score_batch(b, i, table, out, step_seconds, horizon, **kwargs))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or UNTIL_USED_UP)).start()
    )

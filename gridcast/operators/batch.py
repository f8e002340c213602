"""Many jobs at once: fits by a table of job settings, and forecasts and evaluations of stored runs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import SERIES, attach
from gridcast.functions.time import STEP_SECONDS
from gridcast.operators import fleet, intervals
from gridcast.operators.checks import run_guardrails
from gridcast.session import settle
from gridcast.sources.models import ModelStore

JOBS = f"{SERIES} string, model string, lookback int, horizon int, params string"
FAILURES = f"{SERIES} string, model string, lookback int, horizon int, error string"


class JobsStopped(RuntimeError):
    """Raised when jobs stop at their first error; ``failures`` has what was wrong."""

    def __init__(self, message: str, failures: list[tuple]):
        super().__init__(message)
        self.failures = failures


def _setting(r) -> dict:
    return {"model": r["model"], "lookback": r["lookback"], "horizon": r["horizon"], "params": json.loads(r["params"] or "{}")}


def train_jobs(
    readings: DataFrame, step_seconds: int, jobs: DataFrame, store: ModelStore | None = None, stop_at_first_error: bool = False, parallelism: int = 4, **kwargs
) -> dict[str, DataFrame]:
    """Fit every series of ``jobs(series_id, model, lookback, horizon, params)`` by its own settings; ``params`` is a JSON object or null.

    Series of one setting are fitted together; the settings, which are few, run as concurrent Spark jobs under a tag. A
    series that cannot be trained, a setting that is refused and a series without readings go to ``failures`` and the rest goes on;
    with ``stop_at_first_error`` the first of them cancels all running jobs and raises :class:`JobsStopped`. Runs that were finished
    are kept in ``store`` (if given). Returns ``runs``, ``failures`` and ``summary``.
    """
    spark = readings.sparkSession
    jobs = settle(jobs.select(SERIES, "model", "lookback", "horizon", "params").distinct())
    keys = ["model", "lookback", "horizon", "params"]
    settings = jobs.select(*keys).distinct().collect()  # one row per setting
    tag = f"jobs-{uuid.uuid4().hex}"
    present = readings.select(SERIES).distinct()

    def same(r) -> DataFrame:
        d = jobs
        for k in keys:
            d = d.where(F.col(k).eqNullSafe(F.lit(r[k])))
        return d.select(SERIES).distinct()

    def run(r):
        own, s = same(r), _setting(r)
        named = lambda d: d.select(SERIES, F.lit(s["model"]).alias("model"), F.lit(s["lookback"]).alias("lookback"), F.lit(s["horizon"]).alias("horizon"), "error")
        absent = named(own.join(present, SERIES, "left_anti").withColumn("error", F.lit("no readings")))
        try:
            trained = fleet.train_fleet(attach(readings, own, [SERIES]), step_seconds, s["model"], s["lookback"], s["horizon"], params=s["params"], **kwargs)
            bad = settle(named(trained["failures"]).unionByName(absent))
            if not (stop_at_first_error and not bad.isEmpty()):
                runs = settle(trained["runs"])
                if store is not None:
                    store.save({**trained, "runs": runs})
                return runs, bad
        except fleet.FAULTS as e:
            if not stop_at_first_error:
                return None, settle(named(own.withColumn("error", F.lit(f"{type(e).__name__}: {e}"))))
            raise JobsStopped(f"{s['model']}: {e}", [(None, s["model"], s["lookback"], s["horizon"], str(e))]) from e
        found = [tuple(x) for x in bad.limit(100).collect()]  # enough to tell what went wrong
        raise JobsStopped(f"{s['model']}: {found[0][-1]}", found)

    def tagged(r):
        spark.addTag(tag)
        try:
            return run(r)
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(parallelism) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(tagged), r) for r in settings]
        done, rest = wait(waiting, return_when=FIRST_EXCEPTION)
        failed = [f for f in done if f.exception()]
        if failed:
            for f in rest:
                f.cancel()
            spark.interruptTag(tag)
            wait(rest)
            stopped = [f.exception() for f in failed if isinstance(f.exception(), JobsStopped)]
            raise (stopped or [failed[0].exception()])[0]
    results = [f.result() for f in waiting]
    runs, failures = None, spark.createDataFrame([], FAILURES)
    for r, bad in results:
        failures = failures.unionByName(bad)
        if r is not None:
            runs = r if runs is None else runs.unionByName(r)
    if runs is None:
        runs = store.runs([]) if store else spark.createDataFrame([], f"model_id string, {SERIES} string")
    return {"runs": runs, "failures": failures, "summary": fleet.summarise(runs, failures)}


def _by_fit(store: ModelStore, model_ids: Sequence[str] | DataFrame | None, step_seconds: int):
    """Per stored fit of the runs: its settings and the chosen runs; and runs of another step length as failures."""
    label = next((k for k, s in STEP_SECONDS.items() if s == step_seconds), f"{step_seconds}s")
    runs = settle(store.runs(model_ids))
    fits = runs.where(F.col("frequency") == label).groupBy("fit_id", "model_type", "lookback", "horizon", "past_covariates", "future_covariates", "calendar_static").agg(
        F.first("params").alias("params")
    ).collect()  # one row per fit
    wrong = runs.where(F.col("frequency") != label).select(SERIES, "model_id", F.format_string("trained at step %s, readings at %s", "frequency", F.lit(label)).alias("error"))
    return runs, fits, wrong


def _arguments(fit) -> dict:
    """What a stored fit's forecasts need besides the readings."""
    return {
        "params": {k: fleet.typed(v) for k, v in (fit["params"] or {}).items()}, "past": fit["past_covariates"] or [], "future": fit["future_covariates"] or [],
        "calendar_static": fit["calendar_static"] is not False,
    }


def _one_fit(readings: DataFrame, store: ModelStore, runs: DataFrame, fit) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    own = runs.where(F.col("fit_id") == fit["fit_id"]).select(SERIES, "model_id")
    return attach(readings, own.select(SERIES), [SERIES]), own, store.fitted(fit["fit_id"], fit["model_type"])


def forecast_stored(
    readings: DataFrame, step_seconds: int, store: ModelStore, model_ids: Sequence[str] | DataFrame | None = None, horizon: int | None = None, levels: Sequence[float] | None = None
) -> dict[str, DataFrame]:
    """Forward forecasts of stored runs for the series they were trained on: ``forecasts`` (with ``model_id``) and ``failures``.

    ``horizon`` may shorten a run's own. With ``levels`` the forecasts carry bands from the run's stored residual sketches; the point
    forecast becomes the median. Runs of another step length, series without readings and series whose known-ahead covariates do not
    reach over the horizon go to ``failures``.
    """
    runs, fits, failures = _by_fit(store, model_ids, step_seconds)
    found = None
    for fit in fits:
        rows, own, fitted = _one_fit(readings, store, runs, fit)
        taken, steps = _arguments(fit), horizon or fit["horizon"]
        f = fleet.forward_forecast(rows, step_seconds, steps, fit["model_type"], fit["lookback"], fit["horizon"], fitted=fitted, **taken)
        if levels is not None:
            f = intervals.add_bands(f, store.residual_quantiles(fit["fit_id"], levels), levels)
        f = attach(f, own, [SERIES], salts=8)
        found = f if found is None else found.unionByName(f)
        if taken["future"]:
            late = fleet.missing_future(rows, step_seconds, steps, taken["future"]).select(SERIES, "error")
            failures = failures.unionByName(own.join(late, SERIES).select(SERIES, "model_id", "error"))
        known = rows.where(F.col("load").isNotNull()).select(SERIES).distinct()
        failures = failures.unionByName(own.join(known, SERIES, "left_anti").select(SERIES, "model_id", F.lit("no readings").alias("error")))
    return {"forecasts": found, "failures": failures}


def evaluate_stored(
    readings: DataFrame, step_seconds: int, store: ModelStore, model_ids: Sequence[str] | DataFrame | None = None, learn_residuals: bool = False, **kwargs
) -> dict[str, DataFrame]:
    """The blocks of :func:`gridcast.operators.fleet.evaluate` for stored runs over held-out ``readings``, each with ``model_id`` where it has a series.

    ``learn_residuals`` adds what was seen to the stored sketches, so bands follow the newest errors. ``failures`` has runs of another step length, ``guardrails`` what to mind about each run.
    """
    runs, fits, failures = _by_fit(store, model_ids, step_seconds)
    blocks: dict[str, DataFrame] = {}
    for fit in fits:
        rows, own, fitted = _one_fit(readings, store, runs, fit)
        out = fleet.evaluate(rows, step_seconds, fit["model_type"], fit["lookback"], fit["horizon"], fitted=fitted, **_arguments(fit), **kwargs)
        if learn_residuals:
            store.add_residuals(fit["fit_id"], out["forecasts"])
        for name, block in out.items():
            block = attach(block, own, [SERIES], salts=8) if SERIES in block.columns else block
            blocks[name] = blocks[name].unionByName(block) if name in blocks else block
    return {**blocks, "failures": failures, "guardrails": run_guardrails(runs, readings, step_seconds)}

"""Covariates in fits, stored runs and job tables (inventory G and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import batch, checks, fleet, origins
from gridcast.operators.covariates import merge_by_block
from gridcast.operators.grid import off_grid, regular_grid
from gridcast.plans.base import ACTIVITY, HOUR, HOURLY, METRIC_SQL, activity, filled_sql, grid_sql, hourly, origins_sql, query, raw_events, rounded, scored_sql
from gridcast.plans.section_ef import SEQ
from gridcast.plans.section_g import grid_of
from gridcast.session import shared_dir
from gridcast.sources.models import ModelStore

# -- covariates in fits ----------------------------------------------------------------------------------------------

COVERED = f"""{HOURLY}, {ACTIVITY}, {filled_sql('hourly')},
cov AS (SELECT f.series_id, f.ts, f.load, n_events, max_value FROM filled f LEFT JOIN activity USING (ts)),
covered AS (SELECT series_id, ts, load, coalesce(last_value(n_events IGNORE NULLS) OVER b, first_value(n_events IGNORE NULLS) OVER a) AS n_events,
  coalesce(last_value(max_value IGNORE NULLS) OVER b, first_value(max_value IGNORE NULLS) OVER a) AS max_value FROM cov
  WINDOW b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def covered(spark, sf):
    """Hourly load on its grid with two shared covariates."""
    return merge_by_block(grid_of(spark, sf).drop("interpolated"), activity(spark, sf), HOUR, ["n_events", "max_value"]).drop("_blk")


@query("g1_supervised_covariates", rounded(f"""
WITH {COVERED}, w AS (SELECT series_id, ts, lag(load) OVER w AS x_load, lag(max_value, 2) OVER w AS x_past, n_events AS x_now, lead(n_events, 2) OVER w AS x_ahead, load AS y_first,
  lag(load, 2) OVER w AS far, lead(load, 2) OVER w AS y_last FROM covered WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, ts, x_load, x_past, x_now, x_ahead, y_first, y_last FROM w WHERE far IS NOT NULL AND y_last IS NOT NULL""", "x_load x_past x_now x_ahead y_first y_last"))
def g1_covariates(spark, sf):
    """Two lags of the load and of a past covariate, three steps of a known-ahead one."""
    grid = fleet.prepare(covered(spark, sf), HOUR, ["n_events", "max_value"])
    d = origins.supervised(grid, HOUR, 2, 3, past=["max_value"], future=["n_events"])
    x = [F.col("x")[i] for i in range(7)]
    y = [F.col("y")[i] for i in range(3)]
    return d.select("series_id", "ts", x[1].alias("x_load"), x[2].alias("x_past"), x[4].alias("x_now"), x[6].alias("x_ahead"), y[0].alias("y_first"), y[2].alias("y_last"))


# Least squares on two features in closed form.
TWO = """m AS (SELECT series_id, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y
  FROM q GROUP BY ALL),
c AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m))"""


@query("g6_one_covariate", rounded(f"""
WITH {COVERED}, idx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM covered),
p AS (SELECT series_id, ts, i, greatest(1, floor(n * 0.2::DOUBLE)) AS start, lag(load) OVER (PARTITION BY series_id ORDER BY ts) AS x1, n_events AS x2, load AS y FROM idx),
q AS (SELECT * FROM p WHERE x1 IS NOT NULL AND i < start), {TWO}
SELECT p.series_id, 'LinearRegression' AS model, ts AS origin_ts, 1::BIGINT AS h, ts, b0 + b1 * x1 + b2 * x2 AS yhat FROM p JOIN c USING (series_id) WHERE i >= start""", "yhat"))
def g6_covariate(spark, sf):
    """One lag and one known-ahead covariate."""
    grid = fleet.prepare(covered(spark, sf), HOUR, ["n_events"])
    return fleet.forecast(grid, HOUR, "LinearRegression", 1, 1, calendar_static=False, future=["n_events"])


@query("g18_forward_covariate", rounded(f"""
WITH {HOURLY}, {ACTIVITY}, early AS (SELECT * FROM hourly WHERE ts < TIMESTAMP '2024-01-27'), {filled_sql('early')},
p AS (SELECT series_id, ts, lag(load) OVER (PARTITION BY series_id ORDER BY ts) AS x1, load AS y,
  coalesce(last_value(n_events IGNORE NULLS) OVER b, first_value(n_events IGNORE NULLS) OVER a) AS x2
  FROM filled LEFT JOIN (SELECT h.series_id, h.ts, n_events FROM early h JOIN activity USING (ts)) USING (series_id, ts)
  WINDOW b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q AS (SELECT * FROM p WHERE x1 IS NOT NULL), {TWO},
e AS (SELECT series_id, max(ts) + INTERVAL 1 HOUR AS origin_ts, arg_max(y, ts) AS x1 FROM p GROUP BY ALL),
ahead AS (SELECT h.series_id, h.ts, n_events FROM hourly h JOIN activity USING (ts))
SELECT e.series_id, 'LinearRegression' AS model, origin_ts, 1::BIGINT AS h, origin_ts AS ts, b0 + b1 * e.x1 + b2 * n_events AS yhat
FROM e JOIN c USING (series_id) JOIN ahead a ON a.series_id = e.series_id AND a.ts = origin_ts""", "yhat"))
def g18_covariate(spark, sf):
    """A known-ahead covariate read from the rows after the last known load; series without such a row have no forecast."""
    d = hourly(spark, sf).withColumn("load", F.when(F.col("ts") < F.lit("2024-01-27").cast("timestamp_ntz"), F.col("load")))
    d = merge_by_block(d, activity(spark, sf), HOUR, ["n_events"]).drop("_blk")
    return fleet.forward_forecast(d, HOUR, 1, "LinearRegression", 1, future=["n_events"], calendar_static=False)


# -- stored runs and jobs --------------------------------------------------------------------------------------------


def stored_ar(spark, sf):
    """AR(1) of first differences, trained on the earlier part of the load, stored and read back."""
    store = ModelStore(spark, shared_dir(spark, "models"))
    store.save(fleet.train_fleet(hourly(spark, sf), HOUR, "ARIMA", 24, 24, params={"p": 1, "d": 1}))
    return store


PARTS = SEQ.format("filled").replace("i AS (", "q AS (").replace("FROM i)", "FROM q)")
AR = f"""{filled_sql('hourly')}, {PARTS},
z AS (SELECT *, load - lag(load) OVER (PARTITION BY series_id ORDER BY ts) AS z FROM split),
l AS (SELECT *, lag(z) OVER w AS z1, lag(load) OVER w AS l1 FROM z WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
c AS (SELECT series_id, regr_slope(z, z1) AS a, regr_intercept(z, z1) AS b FROM l WHERE role = 'training' GROUP BY ALL)"""
ROLL = "UNION ALL SELECT series_id, origin_ts, h + 1, b + a * z, yhat + b + a * z, a, b FROM r WHERE h < 24"


@query("g17_stored_runs", rounded(f"""
WITH RECURSIVE {HOURLY}, {AR}, e AS (SELECT series_id, max(ts) AS last FROM filled GROUP BY ALL),
r AS (SELECT e.series_id, last + INTERVAL 1 HOUR AS origin_ts, 0::BIGINT AS h, z, load AS yhat, a, b FROM e JOIN l ON l.series_id = e.series_id AND l.ts = last JOIN c ON c.series_id = e.series_id
  {ROLL})
SELECT series_id, 'ARIMA' AS model, origin_ts, h, origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts, yhat FROM r WHERE h > 0""", "yhat"))
def g17_stored(spark, sf):
    """Forward forecasts of all stored runs."""
    return batch.forecast_stored(hourly(spark, sf), HOUR, stored_ar(spark, sf))["forecasts"].drop("model_id")


@query("h16_stored_run", rounded(f"""
WITH RECURSIVE {HOURLY}, {AR}, {origins_sql(24, 24, 24, 0.0)},
r AS (SELECT o.series_id, o.origin_ts, 0::BIGINT AS h, z1 AS z, l1 AS yhat, a, b FROM origins o JOIN l ON l.series_id = o.series_id AND l.ts = o.origin_ts JOIN c ON c.series_id = o.series_id
  {ROLL}),
s AS (SELECT r.series_id, r.h, r.yhat, f.load AS actual FROM r JOIN filled f ON f.series_id = r.series_id AND f.ts = origin_ts + (h - 1) * INTERVAL 1 HOUR WHERE h > 0)
SELECT series_id, {METRIC_SQL} FROM s GROUP BY ALL""", "rmse mae mape cv_rmse r_squared"))
def h16_run(spark, sf):
    """Evaluation of stored runs; nothing is fitted."""
    return batch.evaluate_stored(hourly(spark, sf), HOUR, stored_ar(spark, sf))["metrics"].drop("model_id", "model")


@query("g17_forward_bands", rounded(f"""
WITH {HOURLY}, {scored_sql(fraction=0.0)}, {PARTS},
e AS (SELECT s.series_id, h, quantile_disc(actual - yhat, 0.1) AS r1, quantile_disc(actual - yhat, 0.5) AS r5, quantile_disc(actual - yhat, 0.9) AS r9
  FROM scored s JOIN split p ON p.series_id = s.series_id AND p.ts = s.origin_ts WHERE role = 'validation' GROUP BY ALL),
lastk AS (SELECT series_id, max(ts) + INTERVAL 1 HOUR AS origin_ts FROM hourly WHERE load IS NOT NULL GROUP BY ALL),
ahead AS (SELECT *, origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts FROM lastk CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS h) x)
SELECT a.series_id, 'NaiveSeasonal' AS model, a.origin_ts, a.h, a.ts, f.load + r5 AS yhat, f.load + r1 AS q0_1, f.load + r5 AS q0_5, f.load + r9 AS q0_9
FROM ahead a JOIN filled f ON f.series_id = a.series_id AND f.ts = a.ts - INTERVAL 24 HOUR JOIN e ON e.series_id = a.series_id AND e.h = a.h""", "yhat q0_1 q0_5 q0_9"))
def g17_bands(spark, sf):
    """Bands from the stored sketches of the validation residuals; of so few values a sketch keeps all."""
    store = ModelStore(spark, shared_dir(spark, "models"))
    store.save(fleet.train_fleet(hourly(spark, sf), HOUR, "NaiveSeasonal", 24, 24))
    return batch.forecast_stored(hourly(spark, sf), HOUR, store, levels=[0.1, 0.9])["forecasts"].drop("model_id")


SETTINGS = [
    ("click", "NaiveSeasonal", 24, 24), ("error", "NaiveMean", 48, 12), ("purchase", "NoSuchModel", 24, 24),
    ("signup", "NaiveMean", 99999, 24), ("view", "NaiveMovingAverage", 24, 6), ("nobody", "NaiveMean", 48, 12),
]


@query("g16_job_settings", f"""
WITH {HOURLY}, {filled_sql('hourly')}, n AS (SELECT series_id, count(*) AS n_rows FROM filled GROUP BY ALL), k AS (SELECT series_id, count(*) AS n_known FROM hourly GROUP BY ALL),
j AS (SELECT * FROM (VALUES {', '.join(map(str, SETTINGS))}) v(series_id, model, lookback, horizon))
SELECT j.series_id, j.model, j.lookback::BIGINT AS lookback, j.horizon::BIGINT AS horizon, CASE WHEN series_id IN ('click', 'error', 'view') THEN n_rows END AS n_rows,
  CASE series_id WHEN 'purchase' THEN 'ValueError: unknown model ''NoSuchModel''' WHEN 'nobody' THEN 'no readings' WHEN 'signup' THEN printf('%d rows, 100123 needed', n_known) END AS error
FROM j LEFT JOIN n USING (series_id) LEFT JOIN k USING (series_id)""")
def g16_jobs(spark, sf):
    """Every series by its own settings; three jobs go wrong, the rest goes on."""
    jobs = spark.createDataFrame([(*r, None) for r in SETTINGS], batch.JOBS)
    out = batch.train_jobs(hourly(spark, sf), HOUR, jobs)
    runs = out["runs"].select("series_id", F.col("model_type").alias("model"), "lookback", "horizon", "n_rows", F.lit(None).cast("string").alias("error"))
    return runs.unionByName(out["failures"].withColumn("n_rows", F.lit(None).cast("long")))


@query("g12_guardrails", f"""
WITH {HOURLY}, {scored_sql(fraction=0.0)}, {PARTS},
m AS (SELECT s.series_id, role, 100 * sqrt(avg((actual - yhat) ** 2)) / avg(actual) AS cv FROM scored s JOIN split p ON p.series_id = s.series_id AND p.ts = s.origin_ts GROUP BY ALL),
v AS (SELECT series_id, max(cv) FILTER (WHERE role = 'training') AS t, max(cv) FILTER (WHERE role = 'validation') AS c FROM m GROUP BY ALL),
n AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY ALL), g AS (SELECT series_id, count(*) AS steps, count(*) - count(load) AS n_to_fill FROM grid GROUP BY ALL)
SELECT series_id, n - 24 AS usable_steps, n - 24 < 168 AS short_test, n_to_fill, 0::BIGINT AS n_off_grid, abs(n - steps) / steps <= 0.10 AS overlaps,
  coalesce(t > 0 AND c / t > 2, false) AS overfit, false AS horizon_exceeds_lookback, false AS many_fine_steps, '' AS missing_covariates
FROM n JOIN g USING (series_id) JOIN v USING (series_id)""")
def g12_guardrails(spark, sf):
    """What to mind about each stored run before its evaluation on the same readings is believed."""
    store = ModelStore(spark, shared_dir(spark, "models"))
    store.save(fleet.train_fleet(hourly(spark, sf), HOUR, "NaiveSeasonal", 24, 24))
    return checks.run_guardrails(store.runs(), hourly(spark, sf), HOUR).drop("model_id")


@query("e1_off_grid", """
WITH e AS (SELECT event_type AS series_id, floor(epoch(ts))::BIGINT AS s FROM events),
f AS (SELECT series_id, s % 3600 AS p, arg_min(s % 3600, s) OVER (PARTITION BY series_id) AS first FROM e)
SELECT series_id, count(*) AS n_readings, count(*) FILTER (WHERE p <> first) AS n_off_grid FROM f GROUP BY ALL""")
def e1_off_grid(spark, sf):
    """Readings that a grid of hours, counted from the first reading, leaves out."""
    return off_grid(raw_events(spark, sf), HOUR)


@query("e1_duplicates", rounded(f"""
WITH d AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS load FROM events GROUP BY ALL), {grid_sql('d')} SELECT * FROM grid""", "load"))
def e1_duplicates(spark, sf):
    """Of the readings of an hour the first by event_id stays."""
    d = raw_events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return regular_grid(d.select("series_id", "ts", "load", "event_id"), HOUR, order="event_id")

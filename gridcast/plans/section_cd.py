"""Time filters and joins (inventory C and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import covariates, fleet, intervals, metrics, timefilter
from gridcast.operators.baselines import rolling_seasonal, seasonal_naive
from gridcast.operators.origins import rolling_origins
from gridcast.operators.timefilter import DateWindow
from gridcast.plans.base import (
    ACTIVITY, DAILY, DAY, HOLED, HOUR, HOURLY, SHIPPED, activity, daily, filled_sql, holed, hourly, query, raw_events,
    rounded, scored_sql, shipped,
)
from gridcast.plans.section_ab import RUNS, order_runs
from gridcast.sources import registry


@query("c1_date_window", """
SELECT event_type AS series_id, ts, value AS load, event_id FROM events
WHERE ts >= TIMESTAMP '2024-01-05 06:30:00' AND ts < TIMESTAMP '2024-01-13'""")
def c1(spark, sf):
    return timefilter.filter_window(raw_events(spark, sf), DateWindow("2024-01-05T08:30:00+02:00", "2024-01-12"))


LAGS = "coalesce(lag(load, {k}) OVER (PARTITION BY series_id ORDER BY ts), first_value(load) OVER (PARTITION BY series_id ORDER BY ts))"


@query("c2_buffered_lags", rounded(f"""
WITH {HOURLY}, {filled_sql('hourly')},
l AS (SELECT series_id, ts, load, lag(load, 24) OVER w AS lag_24h, lag(load, 48) OVER w AS lag_48h FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT *, true AS lag_ready FROM l WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-15 12:00:00'""", "load lag_24h lag_48h"))
def c2(spark, sf):
    grid = fleet.prepare(hourly(spark, sf), HOUR).drop("interpolated", "_blk")
    return timefilter.lags_in_window(grid, DateWindow("2024-01-10", "2024-01-15 12:00"), HOUR, (24, 48))


@query("c3_window_report", f"""
WITH {DAILY}, k AS (SELECT *, ts >= TIMESTAMP '1996-02-01' AND ts < TIMESTAMP '1997-03-02' AS keep FROM daily)
SELECT series_id, count(*) FILTER (WHERE keep) AS rows_in_window, count(*) FILTER (WHERE NOT keep) AS rows_excluded,
  min(ts) FILTER (WHERE keep) AS first_kept, max(ts) FILTER (WHERE keep) AS last_kept, min(ts) AS first_ts, max(ts) AS last_ts
FROM k GROUP BY ALL""")
def c3(spark, sf):
    return timefilter.window_report(daily(spark, sf), DateWindow("1996-02-01", "1997-03-01"))


def with_future_rows(spark, sf):
    """Hourly load whose last two days are known only as future rows."""
    return hourly(spark, sf).withColumn("load", F.when(F.col("ts") < F.lit("2024-01-27").cast("timestamp_ntz"), F.col("load")))


@query("c4_context_horizon", rounded(f"""
WITH {HOURLY}, w AS (SELECT series_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-27' THEN load END AS load FROM hourly),
l AS (SELECT *, max(CASE WHEN load IS NOT NULL THEN ts END) OVER (PARTITION BY series_id) AS last_known FROM w)
SELECT *, CASE WHEN ts <= last_known THEN 'context' ELSE 'horizon' END AS part FROM l""", "load"))
def c4(spark, sf):
    return timefilter.context_horizon(with_future_rows(spark, sf))


@query("c5_tail_context", f"""
WITH {HOURLY}, m AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS last FROM hourly)
SELECT series_id, ts, load FROM m WHERE ts > last - INTERVAL 7 DAY""")
def c5(spark, sf):
    return timefilter.tail(hourly(spark, sf))


@query("c6_backtest_start", f"""
WITH {DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n_rows FROM daily),
p AS (SELECT series_id, n_rows, min(CASE WHEN ts >= TIMESTAMP '1996-06-01' THEN idx END) AS start_idx,
  max(CASE WHEN idx = 35 THEN ts END) AS earliest_ts FROM i GROUP BY ALL)
SELECT p.series_id, p.n_rows, p.start_idx, i.ts AS start_ts, p.earliest_ts, NULL::VARCHAR AS error
FROM p LEFT JOIN i ON i.series_id = p.series_id AND i.idx = p.start_idx""")
def c6(spark, sf):
    return timefilter.backtest_start(daily(spark, sf), DAY, 28, date="1996-06-01", warmup_steps=7)


@query("c6_start_fraction", f"""
WITH {HOURLY}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n_rows FROM hourly),
p AS (SELECT series_id, n_rows, greatest(48, floor(n_rows * 0.25::DOUBLE))::BIGINT AS start_idx, max(CASE WHEN idx = 48 THEN ts END) AS earliest_ts FROM i GROUP BY ALL)
SELECT p.series_id, p.n_rows, p.start_idx, i.ts AS start_ts, p.earliest_ts, NULL::VARCHAR AS error
FROM p LEFT JOIN i ON i.series_id = p.series_id AND i.idx = p.start_idx""")
def c6_fraction(spark, sf):
    return timefilter.backtest_start(hourly(spark, sf), HOUR, 48, fraction=0.25)


# -- D -----------------------------------------------------------------------------------------


@query("d1_merge_covariates", rounded(f"""
WITH {HOURLY}, {ACTIVITY} SELECT h.*, n_events, max_value FROM hourly h LEFT JOIN (SELECT * FROM activity WHERE hour(ts) % 5 <> 0) a USING (ts)""", "load n_events max_value"))
def d1(spark, sf):
    return covariates.merge_covariates(hourly(spark, sf), activity(spark, sf).where(F.hour("ts") % 5 != 0))


def autumn_clock(spark, sf):
    """Hourly activity moved into the weeks around a fall-back night."""
    return activity(spark, sf).withColumn("ts", F.col("ts") + F.expr("INTERVAL 665 DAY"))


AUTUMN = ACTIVITY + ", autumn AS (SELECT ts + INTERVAL 665 DAY AS ts, n_events, max_value FROM activity)"


@query("d2_convert_timezone", f"""
WITH {AUTUMN},
z AS (SELECT *, ts AS source_ts, CASE WHEN ts < TIMESTAMP '2025-11-02 09:00:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS off FROM autumn)
SELECT ts - off AS ts, n_events, max_value, source_ts, NULL::VARCHAR AS clock_issue FROM z""")
def d2(spark, sf):
    return covariates.convert_clock(autumn_clock(spark, sf), "UTC", "America/Los_Angeles")


@query("d2_clock_issues", f"""
WITH {AUTUMN},
z AS (SELECT *, ts AS source_ts, CASE WHEN ts < TIMESTAMP '2025-11-02 02:00:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS off FROM autumn)
SELECT ts + off AS ts, n_events, max_value, source_ts,
  CASE WHEN ts >= TIMESTAMP '2025-11-02 01:00:00' AND ts < TIMESTAMP '2025-11-02 02:00:00' THEN 'ambiguous' END AS clock_issue FROM z""")
def d2_issues(spark, sf):
    return covariates.convert_clock(autumn_clock(spark, sf), "America/Los_Angeles", "UTC")


@query("d3_fall_back_duplicates", f"""
WITH {AUTUMN},
z AS (SELECT ts - CASE WHEN ts < TIMESTAMP '2025-11-02 09:00:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS ts, ts AS source_ts, n_events, max_value FROM autumn),
r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY source_ts) AS rn, count(*) OVER (PARTITION BY ts) AS n_copies FROM z)
SELECT ts, n_events, max_value, n_copies FROM r WHERE rn = 1""")
def d3(spark, sf):
    d = covariates.convert_clock(autumn_clock(spark, sf), "UTC", "America/Los_Angeles").drop("clock_issue")
    return covariates.unique_times(d)


@query("d4_fill_covariates", rounded(f"""
WITH {HOURLY}, {ACTIVITY}, m AS (SELECT h.*, CASE WHEN n_events > 12 THEN n_events END AS n_events, CASE WHEN hour(h.ts) > 6 THEN max_value END AS max_value FROM hourly h LEFT JOIN activity a USING (ts))
SELECT series_id, ts, load, coalesce(last_value(n_events IGNORE NULLS) OVER b, first_value(n_events IGNORE NULLS) OVER f) AS n_events,
  coalesce(last_value(max_value IGNORE NULLS) OVER b, first_value(max_value IGNORE NULLS) OVER f) AS max_value, n_events IS NULL OR max_value IS NULL AS was_missing
FROM m WINDOW b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "load n_events max_value"))
def d4(spark, sf):
    a = activity(spark, sf).select("ts", F.when(F.col("n_events") > 12, F.col("n_events")).alias("n_events"), F.when(F.hour("ts") > 6, F.col("max_value")).alias("max_value"))
    return covariates.fill_covariates(covariates.merge_covariates(hourly(spark, sf), a), ["n_events", "max_value"])


@query("d5_merge_report", rounded(f"""
WITH {HOURLY}, {ACTIVITY}, a AS (SELECT ts, n_events FROM activity WHERE ts < TIMESTAMP '2024-01-26'),
j AS (SELECT h.series_id, h.ts, n_events FROM hourly h LEFT JOIN a USING (ts)),
c AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_events IS NULL) AS n_missing_filled, min(ts) AS ls, max(ts) AS le FROM j),
s AS (SELECT min(ts) AS cs, max(ts) AS ce FROM a),
r AS (SELECT *, n_missing_filled / n_rows AS fill_share, (epoch(least(le, ce)) - epoch(greatest(ls, cs))) / (epoch(le) - epoch(ls)) AS overlap FROM c, s)
SELECT 'activity' AS covariate, n_rows, n_missing_filled, fill_share, 0::BIGINT AS duplicates_dropped, overlap, 3600.0::DOUBLE AS load_gap_s, 3600.0::DOUBLE AS cov_gap_s,
  concat_ws('; ', CASE WHEN overlap < 0.95 THEN 'overlap below 95 %' END, CASE WHEN fill_share > 0.05 THEN 'fill share above 5 %' END) AS warnings,
  CASE WHEN fill_share > 0.2 THEN 'stop' WHEN overlap < 0.95 OR fill_share > 0.05 THEN 'warn' ELSE 'ok' END AS verdict,
  CASE WHEN fill_share > 0.2 THEN 'fill share above 20 %' END AS stop_reason FROM r""", "fill_share overlap"))
def d5(spark, sf):
    a = activity(spark, sf).select("ts", "n_events").where(F.col("ts") < F.lit("2024-01-26").cast("timestamp_ntz"))
    return covariates.merge_report(hourly(spark, sf), a, ["n_events"], "activity")


@query("d5_merge_all", rounded(f"""
WITH {DAILY}, {SHIPPED}, a AS (SELECT ts, quantity FROM shipped WHERE month(ts) <> 2), b AS (SELECT ts, discount FROM shipped WHERE day(ts) % 3 <> 0),
m AS (SELECT d.*, quantity, discount FROM daily d LEFT JOIN a USING (ts) LEFT JOIN b USING (ts))
SELECT series_id, ts, load, coalesce(last_value(quantity IGNORE NULLS) OVER b, first_value(quantity IGNORE NULLS) OVER f) AS quantity,
  coalesce(last_value(discount IGNORE NULLS) OVER b, first_value(discount IGNORE NULLS) OVER f) AS discount
FROM m WINDOW b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  f AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "load quantity discount"))
def d5_all(spark, sf):
    s = shipped(spark, sf)
    rows, _report = covariates.merge_all(daily(spark, sf), {
        "quantity": (s.select("ts", "quantity").where(F.month("ts") != 2), ["quantity"]),
        "discount": (s.select("ts", "discount").where(F.dayofmonth("ts") % 3 != 0), ["discount"]),
    })
    return rows


def naive(spark, sf, stride=24, lookback=24, horizon=24, **kwargs):
    """The grid and the seasonal naive forecasts of the hourly table."""
    grid = fleet.prepare(hourly(spark, sf), HOUR)
    o = rolling_origins(grid, HOUR, lookback, horizon, stride=stride, **kwargs)
    return grid, seasonal_naive(grid, o, HOUR, horizon)


def scored(spark, sf, stride=24, lookback=24, horizon=24, **kwargs):
    """Rolling seasonal naive forecasts with actual values."""
    grid = fleet.prepare(hourly(spark, sf), HOUR)
    return metrics.score(rolling_seasonal(grid, HOUR, lookback, horizon, stride=stride, **kwargs), grid)


@query("d6_score_join", rounded(f"WITH {HOURLY}, {scored_sql()} SELECT * FROM scored", "yhat actual"))
def d6(spark, sf):
    grid, f = naive(spark, sf)
    return metrics.score(f, grid)


@query("d7_horizon_lookup", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=6)} SELECT series_id, h, count(*) AS n, avg(actual) AS mean_actual, avg(yhat) AS mean_yhat FROM scored GROUP BY ALL""", "mean_actual mean_yhat"))
def d7(spark, sf):
    return scored(spark, sf, stride=6).groupBy("series_id", "h").agg(
        F.count(F.lit(1)).alias("n"), F.avg("actual").alias("mean_actual"), F.avg("yhat").alias("mean_yhat")
    )


@query("d8_attach_quantiles", rounded(f"""
WITH {HOURLY}, {scored_sql()}, b AS (SELECT series_id, ts, yhat * 0.5 AS q0_1, yhat * 1.5 AS q0_9 FROM scored WHERE h <= 12)
SELECT s.series_id, s.ts, s.yhat, b.q0_1, b.q0_9 FROM scored s LEFT JOIN b USING (series_id, ts)""", "yhat q0_1 q0_9"))
def d8(spark, sf):
    s = scored(spark, sf)
    b = s.where("h <= 12").select("series_id", "ts", (F.col("yhat") * 0.5).alias("q0_1"), (F.col("yhat") * 1.5).alias("q0_9"))
    return intervals.attach_quantiles(s.select("series_id", "ts", "yhat"), b, ["q0_1", "q0_9"])


@query("d9_attach_bands", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=6)} SELECT series_id, origin_ts, h, ts, yhat, CASE WHEN h % 2 = 0 THEN yhat - 1 END AS lo FROM scored""", "yhat lo"))
def d9(spark, sf):
    s = scored(spark, sf, stride=6)
    b = s.where("h % 2 = 0").select("series_id", "origin_ts", "ts", (F.col("yhat") - 1).alias("lo"))
    return intervals.attach_window_bands(s.select("series_id", "origin_ts", "h", "ts", "yhat"), b, ["lo"])


@query("d10_run_context", rounded(f"""
WITH {DAILY}, {RUNS}, best AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cv_rmse ASC NULLS LAST, model_id) AS k FROM latest)
SELECT d.series_id, d.ts, d.load, b.model_id, b.lookback FROM daily d JOIN best b USING (series_id) WHERE k = 1""", "load"))
def d10(spark, sf):
    from gridcast.functions.blocks import attach
    from gridcast.operators.reports import model_comparison

    runs = registry.latest(order_runs(spark, sf))
    best = model_comparison(runs).where("rank = 1").select("model_id")
    context = runs.join(best, "model_id").select("series_id", "model_id", "lookback")
    return attach(daily(spark, sf), context, ["series_id"])

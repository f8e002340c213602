"""Scores (inventory H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import fleet, grid, metrics
from gridcast.plans.base import (
    DAILY, DAY, HOUR, HOURLY, METRIC_COLUMNS, METRIC_SQL, daily, filled_sql, hourly, query, rounded, scored_sql,
)
from gridcast.plans.section_ab import RUNS, order_runs
from gridcast.plans.section_cd import scored
from gridcast.plans.section_ef import CHUNKS
from gridcast.plans.section_g import BANDS, banded
from gridcast.sources import registry

LEVELS = {"q0_1": 0.1, "q0_5": 0.5, "q0_9": 0.9}
FLAT = """flat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY origin_ts) AS rn FROM scored) WHERE rn = 1)"""


@query("h1_point_metrics", rounded(f"WITH {HOURLY}, {scored_sql()} SELECT series_id, {METRIC_SQL} FROM scored GROUP BY ALL", METRIC_COLUMNS))
def h1(spark, sf):
    return metrics.point_metrics(scored(spark, sf))


@query("h1_metric_sets", rounded(f"""
WITH {HOURLY}, {scored_sql()} SELECT series_id, model, {METRIC_SQL} FROM scored GROUP BY GROUPING SETS ((series_id), (model), ())""", METRIC_COLUMNS))
def h1_sets(spark, sf):
    return metrics.metric_sets(scored(spark, sf), [["series_id"], ["model"], []])


@query("h2_pooled_windows", rounded(f"WITH {HOURLY}, {scored_sql(stride=6)} SELECT series_id, model, {METRIC_SQL} FROM scored GROUP BY ALL", METRIC_COLUMNS))
def h2(spark, sf):
    return metrics.point_metrics(scored(spark, sf, stride=6), ["series_id", "model"])


@query("h3_chunk_metrics", rounded(f"""
WITH {DAILY}, {CHUNKS}, n AS (SELECT series_id, chunk_id, count(*) AS n_rows FROM chunked GROUP BY ALL),
s AS (SELECT series_id, load AS actual, load * 0.9::DOUBLE + 50 AS yhat FROM chunked JOIN n USING (series_id, chunk_id) WHERE n_rows > 4)
SELECT series_id, {METRIC_SQL} FROM s GROUP BY ALL""", METRIC_COLUMNS))
def h3(spark, sf):
    d = grid.chunks(daily(spark, sf), DAY)
    s = d.select("series_id", "chunk_id", "ts", F.col("load").alias("actual"), (F.col("load") * 0.9 + 50).alias("yhat"))
    lengths = d.groupBy("series_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return metrics.chunk_metrics(s, lengths, 4)


PEAKS = FLAT + """, k AS (SELECT series_id, ts::DATE AS date, max(actual) AS actual_peak, max(yhat) AS predicted_peak,
  arg_min(hour(ts), (-actual, ts)) AS actual_hour, arg_min(hour(ts), (-yhat, ts)) AS predicted_hour FROM flat GROUP BY ALL),
peaks AS (SELECT *, actual_peak <> 0 AS evaluated, CASE WHEN actual_peak <> 0 THEN 100 * abs(actual_peak - predicted_peak) / actual_peak END AS peak_error_pct,
  CASE WHEN actual_peak <> 0 THEN abs(actual_hour - predicted_hour) END AS timing_error_h FROM k)"""


@query("h4_peak_days", rounded(f"WITH {HOURLY}, {scored_sql(stride=6)}, {PEAKS} SELECT * FROM peaks", "actual_peak predicted_peak peak_error_pct"))
def h4(spark, sf):
    return metrics.peak_days(metrics.flatten(scored(spark, sf, stride=6)))


@query("h4_peak_summary", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=6)}, {PEAKS} SELECT series_id, avg(peak_error_pct) AS peak_mape, avg(timing_error_h) AS peak_timing_error_h,
  count(*) FILTER (WHERE evaluated) AS n_evaluated, count(*) FILTER (WHERE NOT evaluated) AS n_skipped FROM peaks GROUP BY ALL""", "peak_mape peak_timing_error_h"))
def h4_summary(spark, sf):
    return metrics.peak_summary(metrics.peak_days(metrics.flatten(scored(spark, sf, stride=6))))


@query("h5_residual_diagnostics", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=6)}, {FLAT}, e AS (SELECT series_id, actual - yhat AS e, lag(actual - yhat) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM flat)
SELECT series_id, count(*) AS n, avg(e) AS mean_residual, stddev_pop(e) AS std_residual, corr(e, p) AS autocorrelation_lag1 FROM e GROUP BY ALL""", "mean_residual std_residual autocorrelation_lag1"))
def h5(spark, sf):
    return metrics.residual_diagnostics(metrics.flatten(scored(spark, sf, stride=6)), HOUR)


@query("h6_horizon_metrics", rounded(f"""
WITH {HOURLY}, {scored_sql()}, m AS (SELECT series_id, model, h, {METRIC_SQL} FROM scored GROUP BY ALL)
SELECT series_id, model, h, n, rmse, mae, mape FROM m""", "rmse mae mape"))
def h6(spark, sf):
    return metrics.horizon_metrics(scored(spark, sf))


@query("h7_horizon_coverage", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=6)}, {BANDS} SELECT series_id, model, h, avg((actual BETWEEN q0_1 AND q0_9)::INT) AS coverage, avg(q0_9 - q0_1) AS mean_width, count(*) AS n FROM banded GROUP BY ALL""", "coverage mean_width"))
def h7(spark, sf):
    return metrics.horizon_coverage(banded(spark, sf), "q0_1", "q0_9")


@query("h8_interval_metrics", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=6)}, {BANDS}
SELECT series_id, avg((greatest(0.1::DOUBLE * (actual - q0_1), -0.9::DOUBLE * (actual - q0_1)) + 0.5::DOUBLE * abs(actual - q0_5) + greatest(0.9::DOUBLE * (actual - q0_9), -0.1::DOUBLE * (actual - q0_9))) / 3) AS pinball_loss,
  avg((actual BETWEEN q0_1 AND q0_9)::INT) AS coverage, 0.8::DOUBLE AS nominal_coverage, avg(q0_9 - q0_1) AS mean_width FROM banded GROUP BY ALL""", "pinball_loss coverage nominal_coverage mean_width"))
def h8(spark, sf):
    return metrics.interval_metrics(banded(spark, sf), LEVELS)


@query("h8_pinball_by_level", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=6)}, {BANDS}, l AS (SELECT series_id, actual, unnest([{{'q': 0.1::DOUBLE, 'y': q0_1}}, {{'q': 0.5, 'y': q0_5}}, {{'q': 0.9, 'y': q0_9}}]) AS r FROM banded)
SELECT series_id, r.q AS q, avg(greatest(r.q * (actual - r.y), (r.q - 1) * (actual - r.y))) AS pinball FROM l GROUP BY ALL""", "q pinball"))
def h8_levels(spark, sf):
    return metrics.pinball(banded(spark, sf), LEVELS)


@query("h10_compare_validation", rounded(f"""
WITH {HOURLY}, {scored_sql()}, m AS (SELECT series_id, 100 * sqrt(avg((actual - yhat) ** 2)) / avg(actual) AS test_cv_rmse FROM scored GROUP BY ALL),
v AS (SELECT series_id, 100 * sqrt(avg((actual - yhat) ** 2)) / avg(actual) AS validation_cv_rmse FROM scored WHERE h <= 6 GROUP BY ALL)
SELECT *, test_cv_rmse - validation_cv_rmse AS cv_rmse_diff, CASE WHEN abs(test_cv_rmse - validation_cv_rmse) <= 5 THEN 'similar' WHEN test_cv_rmse > validation_cv_rmse THEN 'degraded' ELSE 'improved' END AS performance_status
FROM m JOIN v USING (series_id)""", "test_cv_rmse validation_cv_rmse cv_rmse_diff"))
def h10(spark, sf):
    s = scored(spark, sf)
    return metrics.compare_to_validation(metrics.point_metrics(s), metrics.point_metrics(s.where("h <= 6")))


@query("h11_flatten_longest", rounded(f"WITH {HOURLY}, {scored_sql(stride=6)}, {FLAT} SELECT series_id, model, ts, origin_ts, h, yhat, actual FROM flat", "yhat actual"))
def h11(spark, sf):
    return metrics.flatten(scored(spark, sf, stride=6))


@query("h11_flatten_shortest", rounded(f"WITH {HOURLY}, {scored_sql(stride=6)}, {FLAT.replace('ORDER BY origin_ts', 'ORDER BY origin_ts DESC')} SELECT series_id, model, ts, origin_ts, h, yhat, actual FROM flat", "yhat actual"))
def h11_shortest(spark, sf):
    return metrics.flatten(scored(spark, sf, stride=6), "shortest")


@query("h12_window_metrics", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=6)} SELECT series_id, model, origin_ts, count(*) AS n, avg(abs(actual - yhat)) AS mae, sqrt(avg((actual - yhat) ** 2)) AS rmse FROM scored GROUP BY ALL""", "mae rmse"))
def h12(spark, sf):
    return metrics.window_metrics(scored(spark, sf, stride=6))


@query("h13_error_by_hour", rounded(f"""
WITH {HOURLY}, {scored_sql()}, d AS (SELECT * FROM scored WHERE hour(ts) <> 3), m AS (SELECT series_id, hour(ts) AS hour, avg(abs(actual - yhat)) AS mae FROM d GROUP BY ALL)
SELECT s.series_id, x.hour, m.mae FROM (SELECT DISTINCT series_id FROM d) s CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS hour) x LEFT JOIN m USING (series_id, hour)""", "mae"))
def h13_hour(spark, sf):
    return metrics.error_by_hour(scored(spark, sf).where(F.hour("ts") != 3))


@query("h13_error_by_weekday", rounded(f"""
WITH {HOURLY}, {scored_sql()} SELECT series_id, isodow(ts) - 1 AS dow, avg(abs(actual - yhat)) AS mae, dayname(ts) AS label FROM scored GROUP BY ALL""", "mae"))
def h13_weekday(spark, sf):
    return metrics.error_by_weekday(scored(spark, sf))


@query("h14_backtest_summary", f"""
WITH {HOURLY}, {scored_sql(stride=6)} SELECT series_id, model, count(DISTINCT origin_ts) AS n_windows, 6::BIGINT AS stride, min(ts) AS first_scored_ts, max(ts) AS last_scored_ts, count(*) AS n_scored FROM scored GROUP BY ALL""")
def h14(spark, sf):
    return metrics.backtest_summary(scored(spark, sf, stride=6), 6)


@query("h15_backtest", rounded(f"WITH {HOURLY}, {scored_sql(stride=12, lookback=48)} SELECT series_id, model, {METRIC_SQL} FROM scored GROUP BY ALL", METRIC_COLUMNS))
def h15(spark, sf):
    return fleet.backtest(hourly(spark, sf), HOUR, "NaiveSeasonal", 48, 24, stride=12)["metrics"]


@query("h16_evaluation", rounded(f"WITH {HOURLY}, {scored_sql(fraction=0.0)}, m AS (SELECT series_id, model, h, {METRIC_SQL} FROM scored GROUP BY ALL) SELECT series_id, model, h, n, rmse, mae, mape FROM m", "rmse mae mape"))
def h16(spark, sf):
    return fleet.evaluate(hourly(spark, sf), HOUR, "NaiveSeasonal", 24, 24)["horizon"]


@query("h16_stored_fit", rounded(f"""
WITH {HOURLY}, early AS (SELECT * FROM hourly WHERE ts < TIMESTAMP '2024-01-20'), late AS (SELECT * FROM hourly WHERE ts >= TIMESTAMP '2024-01-20'),
e AS (WITH {filled_sql('early')} SELECT * FROM filled), t AS (SELECT series_id, lag(load) OVER w AS x, load AS y FROM e WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
c AS (SELECT series_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM t WHERE x IS NOT NULL GROUP BY ALL),
f AS (WITH {filled_sql('late')} SELECT * FROM filled), p AS (SELECT series_id, ts AS origin_ts, 1::BIGINT AS h, lag(load) OVER w AS x, load AS actual FROM f WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, 'LinearRegression' AS model, origin_ts, h, origin_ts AS ts, b + a * x AS yhat, actual FROM p JOIN c USING (series_id) WHERE x IS NOT NULL""", "yhat actual"))
def h16_stored(spark, sf):
    d, cut = hourly(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz")
    fitted = fleet.fit(fleet.prepare(d.where(F.col("ts") < cut), HOUR), HOUR, "LinearRegression", 1, 1, calendar_static=False)
    return fleet.evaluate(d.where(F.col("ts") >= cut), HOUR, "LinearRegression", 1, 1, fitted=fitted, calendar_static=False)["forecasts"]


@query("h17_stride_sweep", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=1)}, o AS (SELECT *, (epoch(origin_ts) - epoch(min(origin_ts) OVER (PARTITION BY series_id)))::BIGINT // 3600 AS rel FROM scored),
k AS (SELECT o.*, stride FROM o CROSS JOIN (SELECT unnest([1, 6, 12, 24])::BIGINT AS stride) x WHERE rel % stride = 0)
SELECT series_id, model, stride, {METRIC_SQL} FROM k GROUP BY ALL""", METRIC_COLUMNS))
def h17(spark, sf):
    return fleet.stride_sweep(hourly(spark, sf), HOUR, "NaiveSeasonal", 24, 24)


@query("h17_peak_demand_day", f"""
WITH {DAILY} SELECT series_id, arg_min(ts::DATE, (-load, ts)) AS date, max(load) AS peak FROM daily GROUP BY ALL""")
def h17_day(spark, sf):
    return metrics.peak_demand_day(daily(spark, sf))

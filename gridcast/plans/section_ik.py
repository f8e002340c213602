"""Exploration tables, reports and streaming (inventory I and K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import covariates, profile, reports
from gridcast.operators.metrics import flatten
from gridcast.plans.base import (
    ACTIVITY, BY_FLAG, DAILY, DAY, HOLED, HOUR, HOURLY, SHIPPED, activity, daily, filled_sql, hourly, holed, query, rounded,
    scored_sql, shipped, shipped_by_flag,
)
from gridcast.plans.section_ab import RUNS, SRC, odd_readings, order_runs
from gridcast.plans.section_cd import scored
from gridcast.plans.section_ef import SEASON
from gridcast.plans.section_h import FLAT
from gridcast.session import shared_dir
from gridcast.sources import registry
from gridcast.streaming import live


def with_shipments(spark, sf):
    return covariates.merge_covariates(daily(spark, sf), shipped(spark, sf))


JOINED = f"{DAILY}, {SHIPPED}, j AS (SELECT d.*, quantity, discount FROM daily d LEFT JOIN shipped USING (ts))"


@query("i1_column_statistics", rounded(f"""
WITH {HOLED}, {ACTIVITY}, j AS (SELECT h.*, n_events FROM holed h LEFT JOIN activity USING (ts)),
l AS (SELECT series_id, 'load' AS "column", 'target' AS role, load AS v FROM j UNION ALL SELECT series_id, 'n_events', 'past_covariate', n_events FROM j)
SELECT series_id, "column", role, 'double' AS type, count(*) AS n, count(*) - count(v) AS n_missing, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max,
  count(*) FILTER (WHERE v < 0) AS n_negative, count(*) FILTER (WHERE v = 0) AS n_zero, round(100.0::DOUBLE * count(v) / count(*), 2) AS coverage_pct,
  quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM l GROUP BY ALL""", "mean std min max coverage_pct p5 p95"))
def i1(spark, sf):
    d = covariates.merge_covariates(holed(spark, sf), activity(spark, sf), ["n_events"])
    return profile.column_stats(d, {"load": "target", "n_events": "past_covariate"})


@query("i2_time_range", rounded(f"""
WITH {SRC}, u AS (SELECT series_id, ts, count(*) AS c FROM src GROUP BY ALL)
SELECT series_id, min(ts) AS start_ts, max(ts) AS end_ts, sum(c)::BIGINT AS n_rows_raw, count(*) AS n_rows, sum(c)::BIGINT - count(*) AS n_duplicates,
  (floor((epoch(max(ts)) - epoch(min(ts))) / 3600) + 1)::BIGINT AS expected_rows, round(100.0::DOUBLE * count(*) / (floor((epoch(max(ts)) - epoch(min(ts))) / 3600) + 1), 2) AS coverage_pct
FROM u GROUP BY ALL""", "coverage_pct"))
def i2(spark, sf):
    return profile.time_range(odd_readings(spark, sf), HOUR)


@query("i3_seasonality", rounded(f"""
WITH {HOURLY}, h AS (SELECT series_id, hour(ts) AS b, avg(load) AS m, count(*) AS c FROM hourly GROUP BY ALL), d AS (SELECT series_id, isodow(ts) - 1 AS b, dayname(ts) AS name, avg(load) AS m FROM hourly GROUP BY ALL),
hh AS (SELECT series_id, sum(c)::BIGINT AS n, arg_min(b, (-m, b)) AS peak_hour, arg_min(b, (m, b)) AS trough_hour, max(m) / greatest(min(m), 1e-9) AS hour_ratio FROM h GROUP BY ALL),
dd AS (SELECT series_id, arg_min(name, (-m, b)) AS peak_day, arg_min(name, (m, b)) AS trough_day, max(m) / greatest(min(m), 1e-9) AS day_ratio FROM d GROUP BY ALL)
SELECT *, round(hour_ratio, 4) < 1.05 AS low_diurnal_variation FROM hh JOIN dd USING (series_id) WHERE n >= 48""", "hour_ratio day_ratio"))
def i3(spark, sf):
    return profile.seasonality(hourly(spark, sf))


@query("i4_covariate_correlation", rounded(f"""
WITH {JOINED}, c AS (SELECT series_id, 'quantity' AS "column", corr(load, quantity) AS pearson_r, count(*) FILTER (WHERE load IS NOT NULL AND quantity IS NOT NULL) AS n_overlap_rows FROM j GROUP BY ALL
  UNION ALL SELECT series_id, 'discount', corr(load, discount), count(*) FILTER (WHERE load IS NOT NULL AND discount IS NOT NULL) FROM j GROUP BY ALL)
SELECT series_id, "column", 'past_covariate' AS role, pearson_r, n_overlap_rows, abs(pearson_r) AS abs_pearson_r,
  CASE WHEN abs(pearson_r) >= 0.6 THEN 'strong' WHEN abs(pearson_r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS interpretation,
  row_number() OVER (PARTITION BY series_id ORDER BY abs(pearson_r) DESC, "column") AS rank FROM c WHERE n_overlap_rows >= 10""", "pearson_r abs_pearson_r"))
def i4(spark, sf):
    return profile.covariate_correlation(with_shipments(spark, sf), ["quantity", "discount"])


@query("i5_load_profiles", rounded(f"""
WITH {HOURLY}, e AS (SELECT series_id, 'hour_of_day' AS profile, 'all' AS part, hour(ts) AS bucket, load FROM hourly
  UNION ALL SELECT series_id, 'hour_of_day_by_season', {SEASON}, hour(ts), load FROM hourly
  UNION ALL SELECT series_id, CASE WHEN isodow(ts) >= 6 THEN 'hour_of_day_weekend' ELSE 'hour_of_day_weekday' END, 'all', hour(ts), load FROM hourly
  UNION ALL SELECT series_id, 'day_of_week', 'all', isodow(ts) - 1, load FROM hourly UNION ALL SELECT series_id, 'month', 'all', month(ts), load FROM hourly)
SELECT series_id, profile, part, bucket, avg(load) AS mean, count(*) AS n, quantile_cont(load, 0.25) AS p25, quantile_cont(load, 0.75) AS p75 FROM e GROUP BY ALL""", "mean p25 p75"))
def i5(spark, sf):
    return profile.load_profiles(hourly(spark, sf))


@query("i6_heat_map", rounded("""
SELECT event_type AS series_id, ts::DATE AS date, hour(ts) AS hour, avg(value) AS mean FROM events GROUP BY ALL""", "mean"))
def i6(spark, sf):
    from gridcast.plans.base import raw_events

    return profile.heat_map(raw_events(spark, sf))


CURVE = """s AS (SELECT series_id, min(quantity) AS lo, max(quantity) AS hi FROM j WHERE quantity IS NOT NULL GROUP BY ALL),
b AS (SELECT j.*, lo, (hi - lo) / 24 AS w, least(23, greatest(0, ceil((quantity - lo) / ((hi - lo) / 24)) - 1))::BIGINT AS bin FROM j JOIN s USING (series_id) WHERE quantity IS NOT NULL)"""


@query("i7_relation_curve", rounded(f"""
WITH {JOINED}, {CURVE} SELECT series_id, bin, max(lo + (bin + 0.5) * w) AS x_mid, avg(load) AS mean, count(*) AS n, quantile_cont(load, 0.25) AS p25, quantile_cont(load, 0.75) AS p75 FROM b GROUP BY ALL""", "x_mid mean p25 p75"))
def i7(spark, sf):
    return profile.relation_curve(with_shipments(spark, sf), "quantity")


@query("i9_peak_windows", f"""
WITH {DAILY}, s AS (SELECT *, {SEASON} AS season, min(ts) OVER (PARTITION BY series_id) AS a, max(ts) OVER (PARTITION BY series_id) AS b FROM daily),
p AS (SELECT series_id, season, arg_min(ts, (-load, ts)) AS peak_ts, max(load) AS peak_value, min(a) AS a, min(b) AS b FROM s GROUP BY ALL)
SELECT series_id, season, peak_ts, peak_value, greatest(a, peak_ts - INTERVAL 3 DAY) AS start_ts, least(b, peak_ts + INTERVAL 4 DAY) AS end_ts FROM p""")
def i9(spark, sf):
    return profile.peak_windows(daily(spark, sf))


@query("i10_data_report", f"""
WITH {JOINED}, d AS (SELECT *, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM daily)
SELECT 'columns' AS "table", (SELECT count(DISTINCT series_id) * 3 FROM daily) AS n_rows
UNION ALL SELECT 'gaps', (SELECT count(*) FROM d WHERE epoch(ts) - epoch(p) > 1.5 * 86400)
UNION ALL SELECT 'heat_map', (SELECT count(*) FROM daily)
UNION ALL SELECT 'correlation', (SELECT count(DISTINCT series_id) * 2 FROM daily)
UNION ALL SELECT 'peak_windows', (SELECT count(DISTINCT series_id) * 4 FROM daily)
UNION ALL SELECT 'time_range', (SELECT count(DISTINCT series_id) FROM daily)
UNION ALL SELECT 'series', (SELECT count(*) FROM daily)""")
def i10(spark, sf):
    r = reports.data_report(with_shipments(spark, sf), DAY, ["quantity", "discount"])
    out = None
    for name in ("columns", "gaps", "heat_map", "correlation", "peak_windows", "time_range", "series"):
        line = r[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = line if out is None else out.unionByName(line)
    return out


@query("i11_input_preview", rounded(f"""
WITH {JOINED} SELECT series_id, ts, 'load' AS "column", load AS v FROM j UNION ALL SELECT series_id, ts, 'quantity', quantity FROM j WHERE quantity IS NOT NULL""", "v"))
def i11(spark, sf):
    return reports.input_preview(with_shipments(spark, sf), ["quantity"])


def weekly_curve(spark, sf):
    """A curve per priority: weekly means stand in for losses per round."""
    d = daily(spark, sf)
    return d.groupBy(F.col("series_id").alias("model_id"), F.weekofyear("ts").alias("x")).agg(
        F.avg("load").alias("train"), F.avg(F.when(F.weekday("ts") > 3, F.col("load"))).alias("val")
    )


WEEKLY = f"""{DAILY}, curve AS (SELECT series_id AS model_id, weekofyear(ts) AS x, avg(load) AS train, avg(load) FILTER (WHERE isodow(ts) - 1 > 3) AS val FROM daily GROUP BY ALL)"""


@query("i12_curve_diagnostics", rounded(f"""
WITH {WEEKLY}, v AS (SELECT *, lag(val) OVER (PARTITION BY model_id ORDER BY x) AS prev FROM curve WHERE val IS NOT NULL),
a AS (SELECT model_id, arg_min(x, (val, x)) AS best_x, min(val) AS best_val, max(x) AS last_x, arg_max(val, x) AS final_val, arg_max(prev, x) AS prev_val, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT model_id, arg_max(train, x) AS final_train, count(*) AS n_points FROM curve GROUP BY ALL)
SELECT model_id, n_points, best_x, best_val, final_train, final_val, round(final_val / final_train, 3) AS gap_ratio,
  best_x <> last_x AND final_val > best_val * 1.05 AS over_trained, n >= 3 AND best_x = last_x AND (prev_val - final_val) / prev_val > 0.01 AS still_improving
FROM t LEFT JOIN a USING (model_id)""", "best_val final_train final_val gap_ratio"))
def i12(spark, sf):
    return reports.curve_diagnostics(weekly_curve(spark, sf))


@query("i13_average_curves", rounded(f"WITH {WEEKLY} SELECT left(model_id, 1) AS run, x, avg(train) AS train, avg(val) AS val FROM curve GROUP BY ALL", "train val"))
def i13(spark, sf):
    return reports.average_curves(weekly_curve(spark, sf).withColumn("run", F.substring("model_id", 1, 1)), "run")


def order_trials(spark, sf):
    """Trials per priority: one per month, scored by its total price."""
    d = spark.read.parquet(f"{sf}/orders.parquet")
    m = d.groupBy(F.col("o_orderpriority").alias("study"), F.date_trunc("month", "o_orderdate").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("p")
    )
    trial = F.months_between("m", F.lit("1995-01-01")).cast("int")
    return m.select("study", trial.alias("trial"), F.when(F.col("n") % 4 != 0, F.col("p")).alias("cv_rmse"),
                    F.create_map(F.lit("lag"), (F.col("n") % 3).cast("string"), F.lit("kind"), F.lit("tree"), F.lit("depth"), F.lit("6")).alias("params"))


TRIALS = """trials AS (SELECT o_orderpriority AS study, date_diff('month', DATE '1995-01-01', date_trunc('month', o_orderdate)) AS trial,
  CASE WHEN count(*) % 4 <> 0 THEN round(sum(o_totalprice), 2) END AS cv_rmse, count(*) % 3 AS lag FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate))"""


@query("i14_tuning_study", rounded(f"""
WITH {TRIALS} SELECT study, trial, cv_rmse, min(cv_rmse) OVER (PARTITION BY study ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best_so_far, cv_rmse IS NULL AS failed FROM trials""", "cv_rmse best_so_far"))
def i14(spark, sf):
    return reports.tuning_study(order_trials(spark, sf), "study").drop("params")


@query("i14_tuning_summary", rounded(f"""
WITH {TRIALS} SELECT study, count(*) AS n_trials, count(*) - count(cv_rmse) AS n_failed, arg_min(trial, (cv_rmse, trial)) FILTER (WHERE cv_rmse IS NOT NULL) AS best_trial, min(cv_rmse) AS best_cv_rmse FROM trials GROUP BY ALL""", "best_cv_rmse"))
def i14_summary(spark, sf):
    return reports.tuning_summary(order_trials(spark, sf), "study")


@query("i14_varied_parameters", f"WITH {TRIALS} SELECT 'lag' AS name, count(DISTINCT lag) AS n_values FROM trials HAVING count(DISTINCT lag) > 1")
def i14_varied(spark, sf):
    return reports.varied_parameters(order_trials(spark, sf))


@query("i15_model_comparison", rounded(f"""
WITH {RUNS} SELECT series_id, model_id, model_type, train_cv_rmse, cv_rmse, row_number() OVER (PARTITION BY series_id ORDER BY cv_rmse ASC NULLS LAST, model_id) AS rank,
  coalesce(train_cv_rmse > 0 AND cv_rmse / train_cv_rmse > 2, false) AS overfit FROM latest""", "train_cv_rmse cv_rmse"))
def i15(spark, sf):
    return reports.model_comparison(registry.latest(order_runs(spark, sf)))


@query("i16_clock_checks", rounded(f"""
WITH {HOURLY}, m AS (SELECT series_id, hour(ts) AS hour, avg(load) AS m FROM hourly GROUP BY ALL),
p AS (SELECT series_id, arg_min(hour, (-m, hour)) AS peak_hour, max(m) FILTER (WHERE hour IN (0, 1, 2, 3, 23)) AS night_mean FROM m GROUP BY ALL)
SELECT series_id, 'load' AS "column", peak_hour, night_mean, 16::BIGINT AS lo, 21::BIGINT AS hi, peak_hour BETWEEN 16 AND 21 AND night_mean < 1 AS aligned FROM p""", "night_mean"))
def i16(spark, sf):
    return covariates.clock_checks(hourly(spark, sf), {"load": (16, 21)}, night="load")


@query("i16_clocks_agree", f"""
WITH {HOURLY}, m AS (SELECT series_id, ts < TIMESTAMP '2024-01-16' AS first, hour(ts) AS hour, avg(load) AS m FROM hourly GROUP BY ALL),
p AS (SELECT series_id, arg_min(hour, (-m, hour)) FILTER (WHERE first) AS peak_a, arg_min(hour, (-m, hour)) FILTER (WHERE NOT first) AS peak_b FROM m GROUP BY ALL)
SELECT *, abs(peak_a - peak_b) <= 2 AS agree FROM p""")
def i16_agree(spark, sf):
    d, cut = hourly(spark, sf), F.lit("2024-01-16").cast("timestamp_ntz")
    return covariates.clocks_agree(d.where(F.col("ts") < cut), d.where(F.col("ts") >= cut), "load")


@query("i17_report_predictions", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=12)}, {FLAT} SELECT series_id, model, ts, origin_ts, h, yhat, actual, actual - yhat AS residual FROM flat""", "yhat actual residual"))
def i17(spark, sf):
    return reports.backtest_report(scored(spark, sf, stride=12), HOUR, 12)["predictions"]


# -- K -----------------------------------------------------------------------------------------


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(
        F.col("event_type").alias("series_id"), "ts", F.col("value").alias("load")
    )


CLOSED = """hours AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS hr, value FROM events),
closed AS (SELECT series_id, hr AS ts, sum(value) AS load, count(*) AS n_readings FROM hours
  WHERE hr + INTERVAL 1 HOUR <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 2 HOUR FROM events) GROUP BY ALL)"""


def _live_table(spark, sf):
    out = shared_dir(spark, "live")
    live.write_load(live.regular_load(_stream(spark, sf)), f"{out}/load", f"{out}/ckpt").awaitTermination()
    return out


@query("k1_live_load", rounded(f"WITH {CLOSED} SELECT * FROM closed", "load"))
def k1(spark, sf):
    return spark.read.parquet(f"{_live_table(spark, sf)}/load")


@query("k2_live_forecast", rounded(f"""
WITH {CLOSED}, c AS (SELECT series_id, ts, load FROM closed), {filled_sql('c')}, o AS (SELECT series_id, max(ts) + INTERVAL 1 HOUR AS origin_ts FROM c GROUP BY ALL),
a AS (SELECT *, origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts FROM o CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS h) x)
SELECT a.series_id, 'NaiveSeasonal' AS model, origin_ts, h, a.ts, f.load AS yhat FROM a JOIN filled f ON f.series_id = a.series_id AND f.ts = a.ts - INTERVAL 24 HOUR""", "yhat"))
def k2(spark, sf):
    out = _live_table(spark, sf)
    rows = spark.readStream.schema("series_id string, ts timestamp_ntz, load double, n_readings bigint").parquet(f"{out}/load")
    live.follow(rows, f"{out}/table", f"{out}/forecasts", f"{out}/ckpt2", HOUR, 12).awaitTermination()
    return live.latest_forecasts(spark, f"{out}/forecasts")

"""Sources and checks (inventory A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.time import season
from gridcast.operators import checks, roles
from gridcast.operators.grid import regular_grid
from gridcast.operators.splits import sequential_split
from gridcast.plans.base import (
    DAILY, DAY, HOLED, HOUR, HOURLY, daily, events, filled_sql, grid_sql, holed, hourly, query, raw_events, rounded,
)
from gridcast.session import shared_dir
from gridcast.sources import catalog, readings, registry, weather


# -- A -----------------------------------------------------------------------------------------


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("a1_dataset_catalog", "WITH f AS (" + " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS relative_path, count(*) AS n_rows, {'min(ts), max(ts)' if t == 'events' else 'NULL::TIMESTAMP, NULL::TIMESTAMP'} FROM {t}" for t in TABLES
) + """), g(relative_path, n_rows, min_ts, max_ts) AS (SELECT * FROM f)
SELECT *, 'parquet' AS format, (SELECT count(*) FROM g) AS n_total, false AS truncated FROM g""")
def a1(spark, sf):
    """One row per dataset, a Parquet file or a folder of part files."""
    files = catalog.list_datasets(spark, sf).join(catalog.file_rows(spark, sf), ["relative_path", "format"], "left")
    times = catalog.time_ranges(events(spark, sf), "ts", sf).select("relative_path", "min_ts", "max_ts")
    return files.join(times, "relative_path", "left").select("relative_path", "format", "n_rows", "min_ts", "max_ts", "n_total", "truncated")


@query("a2_dataset_profile", """
WITH t AS (SELECT DISTINCT ts FROM events),
g AS (SELECT epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (ORDER BY ts))) AS gap FROM t)
SELECT 'events.parquet' AS file, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts,
  0::BIGINT AS n_unparseable,
  (SELECT CASE WHEN abs(median(gap) - 900) <= 60 THEN '15min' WHEN abs(median(gap) - 1800) <= 60 THEN '30min'
          WHEN abs(median(gap) - 3600) <= 60 THEN 'h' END FROM g) AS frequency,
  6::BIGINT AS n_columns, 'event_id,user_id,value' AS numeric_columns
FROM events""")
def a2(spark, sf):
    return catalog.profile_files(events(spark, sf), "ts")


@query("a3_csv_lines", """
SELECT event_id, event_type, ts, value, NULL::VARCHAR AS _corrupt FROM events""")
def a3(spark, sf):
    from pyspark.sql import types as T

    lines = events(spark, sf).select(
        F.concat_ws(",", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "value").alias("line")
    )
    schema = T.StructType.fromDDL("event_id bigint, event_type string, ts string, value double")
    d = readings.parse_csv_lines(lines, "line", schema)
    return d.withColumn("ts", F.to_timestamp_ntz("ts", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


@query("a4_parquet_scan", """
SELECT event_type AS series_id, ts, value AS load FROM events WHERE ts >= TIMESTAMP '2024-01-10'""")
def a4(spark, sf):
    d = readings.read_parquet(spark, f"{sf}/events.parquet", ["event_type", "ts", "value"])
    return d.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).toDF("series_id", "ts", "load")


@query("a5_wide_to_long", f"""
WITH {DAILY}, days AS (SELECT DISTINCT ts FROM daily), s AS (SELECT DISTINCT series_id FROM daily)
SELECT s.series_id, days.ts, d.load, dayofyear(days.ts)::BIGINT AS doy
FROM days CROSS JOIN s LEFT JOIN daily d USING (series_id, ts)""")
def a5(spark, sf):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = daily(spark, sf).groupBy("ts").pivot("series_id", names).agg(F.max("load"))
    wide = wide.withColumn("doy", F.dayofyear("ts").cast("double"))
    return readings.wide_to_long(wide, "ts", names, ["doy"]).withColumn("doy", F.col("doy").cast("long"))


@query("a6_result_sink", f"WITH {HOURLY} SELECT series_id, ts, load FROM hourly")
def a6(spark, sf):
    path = shared_dir(spark, "results")
    readings.write_results(hourly(spark, sf), path)
    return spark.read.parquet(path).select("series_id", "ts", "load")


@query("a6_bucketed_sink", f"WITH {HOURLY} SELECT series_id, ts, load FROM hourly WHERE series_id IN ('click', 'view')")
def a6_bucketed(spark, sf):
    """Written by hash buckets; two series are read from their buckets alone."""
    path = shared_dir(spark, "results")
    readings.write_bucketed(hourly(spark, sf), path)
    return readings.read_bucketed(spark, path, ["click", "view"]).select("series_id", "ts", "load")


@query("a3_csv_files", """
SELECT CASE WHEN event_id % 97 <> 0 THEN event_id END AS event_id, event_type, event_id % 97 = 0 AS broken, event_id % 97 = 0 AS kept_as_text FROM events""")
def a3_files(spark, sf):
    """CSV files in which some lines have no number where one belongs."""
    path, broken = shared_dir(spark, "csv"), F.col("event_id") % 97 == 0
    named = F.when(broken, F.concat(F.lit("no-"), "event_id")).otherwise(F.col("event_id").cast("string"))
    events(spark, sf).select(named.alias("event_id"), "event_type").write.option("header", True).csv(path)
    d = readings.read_csv(spark, path, "event_id bigint, event_type string", keep_corrupt=True)
    return d.select("event_id", "event_type", F.col("event_id").isNull().alias("broken"), F.coalesce(F.col("_corrupt").startswith("no-"), F.lit(False)).alias("kept_as_text"))


@query("a7_weather_payload", f"""
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, min(value) AS temperature, max(value) AS relative_humidity
FROM events GROUP BY ALL""")
def a7(spark, sf):
    rows = events(spark, sf, "event_type", "ts", "value").groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg(
        F.min("value").alias("a"), F.max("value").alias("m")
    )
    # one payload per series and day, as a weather service would deliver them
    day = rows.groupBy("event_type", F.to_date("t").alias("d")).agg(F.sort_array(F.collect_list(F.struct("t", "a", "m"))).alias("r"))
    body = F.struct(F.struct(
        F.transform("r", lambda x: F.date_format(x["t"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.col("r.a").alias("temperature_2m"), F.col("r.m").alias("relative_humidity_2m"),
    ).alias("hourly"))
    payloads = day.select(F.col("event_type").alias("series_id"), F.to_json(body).alias("payload"))
    return weather.unpack_weather(payloads, "payload", "minimal", keys=["series_id"])


def order_runs(spark, sf):
    """Run records derived from orders: one model per priority and status and month."""
    d = spark.read.parquet(f"{sf}/orders.parquet")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return d.groupBy("o_orderpriority", "o_orderstatus", month.alias("created_at")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("price"),
        F.min("o_orderdate").cast("timestamp_ntz").alias("train_start"), F.max("o_orderdate").cast("timestamp_ntz").alias("train_end"),
    ).select(
        F.concat_ws("_", "o_orderpriority", "o_orderstatus", F.date_format(F.date_trunc("quarter", "created_at"), "yyyyMM")).alias("model_id"),
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderpriority").alias("building"),
        F.when(F.col("o_orderstatus") == "F", "ARIMA").when(F.col("o_orderstatus") == "O", "LinearRegression").otherwise("NaiveMean").alias("model_type"),
        "created_at", F.lit("h").alias("frequency"),
        (F.col("n_rows") % 96 + 1).cast("int").alias("lookback"), F.lit(24).alias("horizon"),
        "train_start", "train_end", "n_rows",
        (F.col("price") % 7).alias("train_cv_rmse"),
        F.when(F.col("n_rows") % 5 != 0, F.col("price") % 13).alias("cv_rmse"),
        F.array(F.lit("ts"), F.lit("load"), F.when(F.col("n_rows") % 2 == 0, "t_out").otherwise("rh_out")).alias("past_covariates"),
        F.array().cast("array<string>").alias("future_covariates"),
        (F.month("created_at") % 12 == 0).alias("deleted"),
    )


RUNS = """runs AS (
  SELECT concat_ws('_', p, s, strftime(date_trunc('quarter', created_at), '%Y%m')) AS model_id, p AS series_id, p AS building,
    CASE s WHEN 'F' THEN 'ARIMA' WHEN 'O' THEN 'LinearRegression' ELSE 'NaiveMean' END AS model_type, created_at, 'h' AS frequency,
    (n_rows % 96 + 1) AS lookback, 24::BIGINT AS horizon, train_start, train_end, n_rows, price % 7 AS train_cv_rmse,
    CASE WHEN n_rows % 5 <> 0 THEN price % 13 END AS cv_rmse,
    ['ts', 'load', CASE WHEN n_rows % 2 = 0 THEN 't_out' ELSE 'rh_out' END] AS past_covariates,
    month(created_at) % 12 = 0 AS deleted
  FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, date_trunc('month', o_orderdate)::TIMESTAMP AS created_at, count(*) AS n_rows,
          round(sum(o_totalprice), 2) AS price, min(o_orderdate) AS train_start, max(o_orderdate) AS train_end
        FROM orders GROUP BY ALL)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, deleted DESC) AS rn FROM runs)
  WHERE rn = 1 AND NOT deleted)"""


@query("a9_run_registry", rounded(f"""
WITH {RUNS}, hit AS (SELECT * FROM latest WHERE building = '1-URGENT')
SELECT model_id, building, model_type, created_at, cv_rmse, (SELECT count(*) FROM hit) AS n_total
FROM hit ORDER BY cv_rmse ASC NULLS LAST, model_id LIMIT 20""", "cv_rmse"))
def a9(spark, sf):
    store = registry.RunRegistry(spark, shared_dir(spark, "runs"))
    store.save(order_runs(spark, sf))
    d = store.list(building="1-URGENT", sort_by="cv_rmse", limit=20)
    return d.select("model_id", "building", "model_type", "created_at", "cv_rmse", "n_total")


# -- B -----------------------------------------------------------------------------------------


def text_events(spark, sf):
    """Events with the time as text, as a CSV would hold it."""
    return events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "event_type",
        F.col("value").alias("load_kwh"), F.col("user_id").alias("pv_forecast"), F.col("event_id").alias("temp_out"),
        F.lit(1).alias("is_weekend"), F.lit(2).alias("weather_code"),
    )


@query("b1_role_detection", """
SELECT role, column_name FROM (VALUES ('datetime', 'event_time'), ('target', 'load_kwh'),
  ('past_covariate', 'temp_out'), ('target_excluded', 'pv_forecast')) v(role, column_name)""")
def b1(spark, sf):
    d = text_events(spark, sf)
    return roles.detect_roles(d).rows(d)


@query("b2_parse_share", """
SELECT 'event_time' AS column_name, avg((try_cast(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) IS NOT NULL)::INT)::DOUBLE AS share FROM events
UNION ALL SELECT 'event_type', avg((try_cast(event_type AS TIMESTAMP) IS NOT NULL)::INT)::DOUBLE FROM events""")
def b2(spark, sf):
    d = text_events(spark, sf)
    shares = roles.parse_shares(d, ["event_time", "event_type"])
    return spark.createDataFrame(list(shares.items()), "column_name string, share double")


@query("b3_role_hints", """
SELECT column_name, hint FROM (VALUES ('event_type', 'unrecognised'), ('pv_forecast', 'unrecognised'),
  ('is_weekend', 'unrecognised'), ('weather_code', 'unrecognised'), ('event_type', 'future_covariate_candidate'),
  ('pv_forecast', 'future_covariate_candidate'), ('is_weekend', 'redundant_calendar'),
  ('weather_code', 'categorical_code'), ('pv_forecast', 'target_excluded')) v(column_name, hint)""")
def b3(spark, sf):
    d = text_events(spark, sf)
    return roles.role_hints(d, roles.detect_roles(d))


@query("b4_mapping_validation", """
SELECT event_type AS series_id, ts, value AS load, event_id FROM events""")
def b4(spark, sf):
    d = events(spark, sf)
    kept, _gone = roles.validate_roles(d, roles.ColumnRoles("ts", "value", ["event_id", "no_such_column"]))
    return roles.to_readings(d, kept, "event_type")


@query("b5_timestamp_parse", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS ts
FROM events""")
def b5(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, stamp).when(F.col("event_id") % 3 == 1, F.concat(stamp, F.lit("+02:00"))).otherwise("bad")
    d = events(spark, sf, "event_id", "ts").select("event_id", text.alias("text"))
    return readings.with_parsed_ts(d, "text", strict=False).select("event_id", "ts")


@query("b6_deduplicate", """
SELECT series_id, ts, load, event_id, n_copies FROM (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, value AS load, event_id,
    row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS n_copies
  FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id)) WHERE rn = 1""")
def b6(spark, sf):
    d = raw_events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return readings.deduplicate(d, "event_id")


@query("b7_target_coverage", rounded(f"""
WITH {HOLED} SELECT series_id, count(*) AS n_rows, count(load) AS n_known, count(load) / count(*) AS coverage,
  count(load) / count(*) >= 0.9 AS passes FROM holed GROUP BY ALL""", "coverage"))
def b7(spark, sf):
    return checks.target_coverage(holed(spark, sf))


FREQ = """freq AS (SELECT series_id, median(gap)::DOUBLE AS median_gap_s FROM (
  SELECT series_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS gap FROM {0}) WHERE gap IS NOT NULL GROUP BY ALL),
named AS (SELECT *, CASE WHEN abs(median_gap_s - 900) <= 60 THEN '15min' WHEN abs(median_gap_s - 1800) <= 60 THEN '30min'
  WHEN abs(median_gap_s - 3600) <= 60 THEN 'h' END AS frequency FROM freq)"""


@query("b8_frequency_inference", f"WITH {HOURLY}, {FREQ.format('hourly')} SELECT series_id, median_gap_s, frequency FROM named")
def b8(spark, sf):
    return checks.infer_frequency(hourly(spark, sf))


@query("b9_frequency_verdict", f"""
WITH {DAILY}, {FREQ.format('daily')} SELECT series_id, median_gap_s, frequency, 'h' AS declared, coalesce(frequency = 'h', false) AS matches,
  frequency IS NOT NULL AS supported, CASE WHEN frequency IS NULL THEN 'resample to 15min, 30min or h' END AS recommendation FROM named""")
def b9(spark, sf):
    return checks.frequency_verdict(daily(spark, sf), "h")


@query("b10_negative_targets", """
SELECT c_mktsegment AS series_id, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative, count(c_acctbal) AS n_known
FROM customer GROUP BY ALL""")
def b10(spark, sf):
    d = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_mktsegment").alias("series_id"), F.col("c_acctbal").alias("load"))
    return checks.negative_targets(d)


@query("b11_missing_policy", f"WITH {HOLED} SELECT series_id, ts, load FROM holed WHERE load IS NOT NULL")
def b11(spark, sf):
    return checks.apply_missing_policy(holed(spark, sf), "drop", HOUR)


@query("b12_covariate_match", f"""
WITH {RUNS} SELECT model_id, CASE WHEN list_contains(past_covariates, 't_out') THEN '' ELSE 'rh_out' END AS missing,
  CASE WHEN list_contains(past_covariates, 't_out') THEN '' ELSE 't_out' END AS extra, NOT list_contains(past_covariates, 't_out') AS error
FROM latest""")
def b12(spark, sf):
    return checks.covariate_mismatch(registry.latest(order_runs(spark, sf)), ["ts", "load", "t_out"])


@query("b13_training_overlap", f"""
WITH {DAILY}, {RUNS}, t AS (SELECT series_id, min(ts) AS a, max(ts) AS b, count(*) AS n_test FROM daily
  WHERE ts BETWEEN TIMESTAMP '1998-04-10' AND TIMESTAMP '1998-06-20' GROUP BY ALL)
SELECT r.model_id, r.series_id, r.n_rows, t.n_test,
  a >= train_start AND b <= train_end AND abs(n_test - r.n_rows) / greatest(r.n_rows, 1) <= 0.10 AS overlaps
FROM latest r JOIN t USING (series_id)""")
def b13(spark, sf):
    t = daily(spark, sf).where(F.col("ts").between(F.lit("1998-04-10").cast("timestamp_ntz"), F.lit("1998-06-20").cast("timestamp_ntz")))
    return checks.training_overlap(registry.latest(order_runs(spark, sf)), t)


@query("b14_short_test", f"""
WITH {HOURLY} SELECT series_id, count(*) - 500 AS usable_steps, count(*) - 500 < 168 AS short FROM hourly GROUP BY ALL""")
def b14(spark, sf):
    return checks.short_test(hourly(spark, sf), 500, HOUR)


@query("b15_interpolated_targets", f"""
WITH {HOLED}, {grid_sql('holed')} SELECT series_id, count(*) AS n_steps, count(*) - count(load) AS n_to_fill, count(*) > count(load) AS warn
FROM grid GROUP BY ALL""")
def b15(spark, sf):
    return checks.interpolated_targets(holed(spark, sf), HOUR)


@query("b16_overfitting", rounded(f"""
WITH {RUNS} SELECT model_id, train_cv_rmse, cv_rmse, CASE WHEN train_cv_rmse > 0 THEN cv_rmse / train_cv_rmse END AS ratio,
  coalesce(train_cv_rmse > 0 AND cv_rmse / train_cv_rmse > 2, false) AS overfit FROM latest""", "train_cv_rmse cv_rmse ratio"))
def b16(spark, sf):
    return checks.overfitting(registry.latest(order_runs(spark, sf)))


@query("b17_config_warnings", f"""
WITH {RUNS} SELECT model_id, horizon > lookback AS horizon_exceeds_lookback, false AS many_fine_steps FROM latest""")
def b17(spark, sf):
    return checks.config_warnings(registry.latest(order_runs(spark, sf)))


@query("b18_minimum_length", f"""
WITH {HOURLY} SELECT series_id, count(*) AS n_rows,
  CASE WHEN count(*) < 660 THEN printf('%d rows, %d needed', count(*), 660) END AS error, count(*) < 500 AS below_advised_rows,
  count(*) < 168 AS short_context, count(*) >= 536 AS context_covers_lookback FROM hourly GROUP BY ALL""")
def b18(spark, sf):
    return checks.minimum_length(hourly(spark, sf), 536, 24, HOUR)


PROFILE = f"""
u AS (SELECT series_id, ts, min(load) AS load, count(*) AS n_copies FROM src GROUP BY ALL),
base AS (SELECT series_id, sum(n_copies)::BIGINT AS n_rows_raw, count(*) AS n_rows, count(*) - count(load) AS n_missing,
  count(*) FILTER (WHERE load < 0) AS n_negative, count(*) FILTER (WHERE load = 0) AS n_zero, min(ts) AS start_ts, max(ts) AS end_ts,
  count(*) FILTER (WHERE month(ts) IN (3, 11)) AS n_dst_months FROM u GROUP BY ALL),
{FREQ.format('u')},
d AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS delta FROM u),
gap AS (SELECT series_id, count(*) AS n_gaps, sum(round(delta / 3600) - 1)::BIGINT AS missing_steps FROM d WHERE delta > 5400 GROUP BY ALL),
k AS (SELECT *, load - lag(load) OVER (PARTITION BY series_id ORDER BY ts) AS step FROM u WHERE load IS NOT NULL),
st AS (SELECT series_id, avg(load) AS m, stddev_samp(load) AS s, 3 * stddev_samp(abs(step)) AS thr, count(*) AS c FROM k GROUP BY ALL),
o AS (SELECT series_id, count(*) FILTER (WHERE c >= 10 AND s > 0 AND abs(load - m) > 3 * s) AS n_outliers,
  count(*) FILTER (WHERE c >= 10 AND thr >= greatest(abs(m) * 0.01, 1e-6) AND abs(step) > thr) AS n_spikes FROM k JOIN st USING (series_id) GROUP BY ALL),
hr AS (SELECT series_id, hour(ts) AS h, avg(load) AS m, count(*) AS c FROM u WHERE load IS NOT NULL GROUP BY ALL),
ratio AS (SELECT series_id, CASE WHEN sum(c) >= 48 THEN max(m) / greatest(min(m), 1e-9) END AS hourly_ratio FROM hr GROUP BY ALL),
p AS (SELECT b.*, median_gap_s, frequency, coalesce(n_gaps, 0) AS n_gaps, coalesce(missing_steps, 0) AS missing_steps, n_outliers, n_spikes, hourly_ratio,
  n_rows_raw - n_rows AS n_duplicates, (floor((epoch(end_ts) - epoch(start_ts)) / 3600) + 1)::BIGINT AS expected_rows,
  round(100.0::DOUBLE * n_rows / greatest(floor((epoch(end_ts) - epoch(start_ts)) / 3600) + 1, 1), 2) AS coverage_pct
  FROM base b LEFT JOIN named USING (series_id) LEFT JOIN gap USING (series_id) LEFT JOIN o USING (series_id) LEFT JOIN ratio USING (series_id))"""
SRC = HOLED + """, src AS (SELECT series_id, CASE WHEN hour(ts) = 5 THEN ts - INTERVAL 1 HOUR ELSE ts END + INTERVAL 7 HOUR AS ts, load FROM holed)"""


def odd_readings(spark, sf):
    """Holed readings with doubled times and a shifted clock."""
    d = holed(spark, sf)
    t = F.when(F.hour("ts") == 5, F.col("ts") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts"))
    return d.withColumn("ts", t + F.expr("INTERVAL 7 HOUR"))


@query("b19_series_profile", rounded(f"WITH {SRC}, {PROFILE} SELECT * FROM p", "median_gap_s hourly_ratio coverage_pct", 4), digits=4)
def b19_profile(spark, sf):
    return checks.series_profile(odd_readings(spark, sf), HOUR)


@query("b19_quality_flags", f"""
WITH {SRC}, {PROFILE},
f AS (SELECT p.series_id, unnest([
  {{'flag': 'LOAD_ERROR', 'on': n_missing > 0.1 * n_rows, 'detail': 'target coverage below 90 %'}},
  {{'flag': 'FREQUENCY_MISMATCH', 'on': frequency IS DISTINCT FROM '30min', 'detail': coalesce(frequency, 'unknown')}},
  {{'flag': 'UNSUPPORTED_FREQUENCY', 'on': frequency IS NULL, 'detail': coalesce(frequency, 'unknown')}},
  {{'flag': 'DUPLICATES', 'on': n_duplicates > 0, 'detail': n_duplicates::VARCHAR}},
  {{'flag': 'LOW_COVERAGE', 'on': frequency IS NOT NULL AND coverage_pct < 90, 'detail': coverage_pct::VARCHAR}},
  {{'flag': 'GAPS', 'on': n_gaps > 0, 'detail': n_gaps::VARCHAR}},
  {{'flag': 'OUTLIERS', 'on': n_outliers > 0, 'detail': n_outliers::VARCHAR}},
  {{'flag': 'SPIKE', 'on': n_spikes > 0, 'detail': n_spikes::VARCHAR}},
  {{'flag': 'LOW_DIURNAL_VARIATION', 'on': round(hourly_ratio, 4) < 1.05, 'detail': 'peak/trough below 1.05'}},
  {{'flag': 'MISSING_VALUES', 'on': n_missing > 0, 'detail': n_missing::VARCHAR}},
  {{'flag': 'NEGATIVE_TARGET', 'on': n_negative > 0, 'detail': n_negative::VARCHAR}},
  {{'flag': 'POSSIBLE_UTC', 'on': n_rows > 24 AND (hour(start_ts) <> 0 OR minute(start_ts) <> 0), 'detail': strftime(start_ts, '%H:%M')}},
  {{'flag': 'DST_MERGE_RISK', 'on': n_rows > 24 AND (hour(start_ts) <> 0 OR minute(start_ts) <> 0) AND n_dst_months > 0, 'detail': 'March or November'}}
]) AS r FROM p)
SELECT series_id, r.flag AS flag, r.detail AS detail FROM f WHERE r.on""")
def b19_flags(spark, sf):
    return checks.quality_flags(checks.series_profile(odd_readings(spark, sf), HOUR), "30min")


@query("b19_readiness", f"""
WITH {SRC}, {PROFILE} SELECT series_id, n_rows,
  concat_ws(',', CASE WHEN n_missing > 0.1 * n_rows THEN 'LOAD_ERROR' END, CASE WHEN frequency IS NULL THEN 'UNSUPPORTED_FREQUENCY' END) AS blocking,
  NOT (n_missing > 0.1 * n_rows OR frequency IS NULL) AS ready, n_rows >= 130 AS long_enough, n_rows < 500 AS below_advised_rows FROM p""")
def b19_ready(spark, sf):
    p = checks.series_profile(odd_readings(spark, sf), HOUR)
    return checks.readiness(p, checks.quality_flags(p))


@query("b20_clock_risk", f"""
WITH {DAILY} SELECT series_id, count(*) > 24 AND hour(min(ts)) <> 0 AS possible_utc,
  count(*) > 24 AND hour(min(ts)) <> 0 AND count(*) FILTER (WHERE month(ts) IN (3, 11)) > 0 AS dst_merge_risk
FROM (SELECT series_id, ts + INTERVAL 16 HOUR AS ts FROM daily) GROUP BY ALL""")
def b20(spark, sf):
    d = daily(spark, sf).withColumn("ts", F.col("ts") + F.expr("INTERVAL 16 HOUR"))
    p = checks.series_profile(d, DAY)
    f = checks.quality_flags(p).groupBy("series_id").agg(
        F.count_if(F.col("flag") == "POSSIBLE_UTC").alias("u"), F.count_if(F.col("flag") == "DST_MERGE_RISK").alias("d")
    )
    return f.select("series_id", (F.col("u") > 0).alias("possible_utc"), (F.col("d") > 0).alias("dst_merge_risk"))


@query("b21_training_span", rounded(f"""
WITH {HOURLY}, s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM hourly)
SELECT series_id, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS span_days, avg((i < floor(n * 0.8::DOUBLE))::INT) AS train_share,
  date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 < 365 AS short_span,
  abs(avg((i < floor(n * 0.8::DOUBLE))::INT) - 0.8) <= 0.05 AS ratio_ok FROM s GROUP BY ALL""", "train_share"))
def b21(spark, sf):
    d = hourly(spark, sf)
    return checks.training_span(d, sequential_split(d, HOUR))

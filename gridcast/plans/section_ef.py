"""Time-series transforms and splits (inventory E and F)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridcast.operators import features, fleet, grid, outliers, splits
from gridcast.plans.base import (
    BY_FLAG, DAILY, DAY, HOLED, HOUR, HOURLY, LINE, daily, events, filled_sql, grid_sql, holed, hourly,
    known_sql, query, rounded, shipped_by_flag,
)


@query("e1_regular_grid", rounded(f"WITH {HOURLY}, {grid_sql('hourly')} SELECT * FROM grid", "load"))
def e1(spark, sf):
    return grid.regular_grid(hourly(spark, sf), HOUR)


@query("e2_interpolate", rounded(f"""
WITH {HOLED}, {grid_sql('holed')}, {known_sql('grid')},
f AS (SELECT series_id, ts, load AS raw, CASE WHEN load IS NOT NULL THEN load
  WHEN pt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN epoch(nt) - epoch(pt) <= 10800 THEN {LINE} END ELSE pv END AS load FROM known)
SELECT series_id, ts, load, raw IS NULL AND load IS NOT NULL AS interpolated FROM f""", "load"))
def e2(spark, sf):
    return grid.interpolate(grid.regular_grid(holed(spark, sf), HOUR), HOUR, max_gap_seconds=3 * HOUR)


@query("e3_fill_all", rounded(f"WITH {HOLED}, {filled_sql('holed')} SELECT f.*, g.load IS NULL AS interpolated FROM filled f JOIN grid g USING (series_id, ts)", "load"))
def e3(spark, sf):
    return fleet.prepare(holed(spark, sf), HOUR)


GAPS = """d AS (SELECT *, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS p FROM hourly),
g AS (SELECT series_id, p AS last_before, ts AS first_after, (round((epoch(ts) - epoch(p)) / 3600) - 1)::BIGINT AS missing_steps, (epoch(ts) - epoch(p)) / 3600 AS hours
  FROM d WHERE epoch(ts) - epoch(p) > 5400)"""


@query("e4_gap_report", f"""
WITH {HOURLY}, {GAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY hours DESC, first_after) AS rank FROM g)
SELECT * FROM r WHERE rank <= 5""")
def e4(spark, sf):
    return grid.gap_summary(hourly(spark, sf), HOUR)[1]


@query("e4_gap_totals", f"""
WITH {HOURLY}, {GAPS} SELECT series_id, count(*) AS n_gaps, sum(missing_steps)::BIGINT AS total_missing_steps, max(hours) AS largest_gap_hours,
  arg_min(first_after, (-hours, first_after)) AS largest_gap_start FROM g GROUP BY ALL""")
def e4_totals(spark, sf):
    return grid.gap_summary(hourly(spark, sf), HOUR)[0]


@query("e5_gap_list", f"WITH {HOURLY}, {GAPS} SELECT * FROM g")
def e5(spark, sf):
    return grid.gaps(hourly(spark, sf), HOUR)


CHUNKS = """c0 AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) > 86400 THEN 1 ELSE 0 END AS s FROM daily),
chunked AS (SELECT series_id, ts, load, sum(s) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk_id FROM c0)"""


@query("e6_contiguous_chunks", f"""
WITH {DAILY}, {CHUNKS} SELECT series_id, chunk_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM chunked GROUP BY ALL""")
def e6(spark, sf):
    return grid.chunk_spans(daily(spark, sf), DAY)


@query("e7_calendar_features", rounded(f"""
WITH {HOURLY} SELECT series_id, ts, load, hour(ts) AS cal_hour, isodow(ts) - 1 AS cal_dow, month(ts) AS cal_month, (isodow(ts) >= 6)::BIGINT AS cal_is_weekend,
  sin(hour(ts) * {2 * math.pi / 24!r}::DOUBLE) AS cal_hour_sin, cos(hour(ts) * {2 * math.pi / 24!r}::DOUBLE) AS cal_hour_cos,
  sin((isodow(ts) - 1) * {2 * math.pi / 7!r}::DOUBLE) AS cal_dow_sin, cos((isodow(ts) - 1) * {2 * math.pi / 7!r}::DOUBLE) AS cal_dow_cos,
  sin((month(ts) - 1) * {2 * math.pi / 12!r}::DOUBLE) AS cal_month_sin, cos((month(ts) - 1) * {2 * math.pi / 12!r}::DOUBLE) AS cal_month_cos
FROM hourly""", "load cal_hour_sin cal_hour_cos cal_dow_sin cal_dow_cos cal_month_sin cal_month_cos"))
def e7(spark, sf):
    return features.calendar_features(hourly(spark, sf))


def _lag(k):
    return f"coalesce(lag(v, {k}) OVER w, first_value(load IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query("e8_lag_features", rounded(f"""
WITH {HOLED}, {grid_sql('holed')}, k AS (SELECT *, last_value(load IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM grid)
SELECT series_id, ts, load, {_lag(24)} AS lag_24h, {_lag(48)} AS lag_48h, {_lag(168)} AS lag_168h,
  ts >= min(ts) OVER (PARTITION BY series_id) + INTERVAL 168 HOUR AS lag_ready
FROM k WINDOW w AS (PARTITION BY series_id ORDER BY ts)""", "load lag_24h lag_48h lag_168h"))
def e8(spark, sf):
    return features.lag_features(grid.regular_grid(holed(spark, sf), HOUR), HOUR)


SEQ = """i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n_rows FROM {0}),
split AS (SELECT *, CASE WHEN idx < floor(n_rows * 0.8::DOUBLE) THEN 'training' ELSE 'validation' END AS role, 'sequential' AS strategy FROM i)"""


@query("e11_min_max_scale", rounded(f"""
WITH {HOURLY}, {SEQ.format('hourly')}, p AS (SELECT series_id, min(load) AS lo, max(load) AS hi FROM split WHERE role = 'training' GROUP BY ALL)
SELECT s.series_id, s.ts, (load - lo) / (hi - lo) AS load, role FROM split s JOIN p USING (series_id)""", "load"))
def e11(spark, sf):
    s = splits.sequential_split(hourly(spark, sf), HOUR)
    return features.scale(s, features.fit_scaler(s, ["load"]), ["load"]).select("series_id", "ts", "load", "role")


@query("e11_inverse_scale", f"WITH {HOURLY} SELECT series_id, ts, load FROM hourly")
def e11_inverse(spark, sf):
    s = splits.sequential_split(hourly(spark, sf), HOUR)
    p = features.fit_scaler(s, ["load"])
    return features.unscale(features.scale(s, p, ["load"]), p, ["load"]).select("series_id", "ts", "load")


@query("e12_hourly_mean", rounded("""
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS load FROM events GROUP BY ALL""", "load"))
def e12(spark, sf):
    from gridcast.sources.readings import resample

    return resample(events(spark, sf, "event_type", "ts", "value"), "hour", "avg", "value", "event_type")


SEASON = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'fall' END"


@query("e13_season_spans", f"""
WITH {DAILY}, s AS (SELECT *, {SEASON} AS season FROM daily),
c AS (SELECT *, (season <> lag(season) OVER (PARTITION BY series_id ORDER BY ts))::INT AS b FROM s),
k AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS span FROM c)
SELECT series_id, span, season, min(ts) AS start_ts, max(ts) AS end_ts FROM k GROUP BY ALL""")
def e13(spark, sf):
    return splits.season_spans(daily(spark, sf), DAY)


KNOTS = ", ".join(f"quantile_cont(load, {p}) AS k{i}" for i, p in enumerate((0.1, 0.5, 0.9)))


@query("e14_temperature_features", rounded(f"""
WITH {HOURLY}, k AS (SELECT series_id, {KNOTS} FROM hourly GROUP BY ALL)
SELECT h.series_id, ts, load, greatest(0.0::DOUBLE, 18 - load) AS temp_hdd, greatest(0.0::DOUBLE, load - 22) AS temp_cdd,
  greatest(0.0::DOUBLE, load - k0) ** 3 AS temp_spline_0, greatest(0.0::DOUBLE, load - k1) ** 3 AS temp_spline_1, greatest(0.0::DOUBLE, load - k2) ** 3 AS temp_spline_2
FROM hourly h JOIN k USING (series_id)""", "load temp_hdd temp_cdd temp_spline_0 temp_spline_1 temp_spline_2", 3), digits=3)
def e14(spark, sf):
    d = hourly(spark, sf)  # the load column stands in for a temperature
    return features.temperature_features(d, "load", features.temperature_knots(d, "load"))


@query("e16_value_outliers", rounded(f"""
WITH {HOURLY}, s AS (SELECT series_id, avg(load) AS m, stddev_samp(load) AS s, count(load) AS n_known FROM hourly GROUP BY ALL),
o AS (SELECT series_id, ts, load, m - 3 * s AS threshold_low, m + 3 * s AS threshold_high, n_known FROM hourly JOIN s USING (series_id) WHERE n_known >= 10 AND abs(load - m) > 3 * s),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(load) DESC, ts) AS rank FROM o) SELECT * FROM r WHERE rank <= 5""", "load threshold_low threshold_high"))
def e16(spark, sf):
    return outliers.top_by(outliers.value_outliers(hourly(spark, sf)), F.abs("load"))


@query("e17_step_spikes", rounded(f"""
WITH {HOURLY}, d AS (SELECT *, lag(load) OVER (PARTITION BY series_id ORDER BY ts) AS value_before, load - lag(load) OVER (PARTITION BY series_id ORDER BY ts) AS step FROM hourly),
s AS (SELECT series_id, 3 * stddev_samp(abs(step)) AS threshold, count(step) AS n_steps, avg(load) AS m FROM d GROUP BY ALL),
o AS (SELECT d.*, threshold, n_steps FROM d JOIN s USING (series_id) WHERE abs(step) > threshold AND threshold >= greatest(abs(m) * 0.01, 1e-6)),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(step) DESC, ts) AS rank FROM o) SELECT * FROM r WHERE rank <= 5""", "load value_before step threshold"))
def e17(spark, sf):
    return outliers.top_by(outliers.spikes(hourly(spark, sf), HOUR), F.abs("step"))


@query("e18_stride_thinning", f"""
WITH {HOURLY}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n_rows FROM hourly)
SELECT * FROM i WHERE idx % ceil(n_rows / 100)::BIGINT = 0""")
def e18(spark, sf):
    return outliers.thin(hourly(spark, sf), HOUR, 100)


# -- F -----------------------------------------------------------------------------------------


@query("f1_sequential_split", rounded(f"WITH {DAILY}, {SEQ.format('daily')} SELECT * FROM split", "load"))
def f1(spark, sf):
    return splits.sequential_split(daily(spark, sf), DAY)


SEASONAL = f"""s0 AS (SELECT *, {SEASON} AS season FROM {{0}}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY series_id, season ORDER BY ts) - 1 AS si, count(*) OVER (PARTITION BY series_id, season) AS sn,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s0),
ok AS (SELECT series_id, count(*) = 4 AND bool_and(floor(sn * 0.8::DOUBLE) > 0 AND floor(sn * 0.8::DOUBLE) < sn) AS usable FROM (SELECT DISTINCT series_id, season, sn FROM s1) GROUP BY ALL),
split AS (SELECT series_id, ts, load, season, CASE WHEN CASE WHEN usable THEN si < floor(sn * 0.8::DOUBLE) ELSE i < floor(n * 0.8::DOUBLE) END THEN 'training' ELSE 'validation' END AS role,
  CASE WHEN usable THEN 'seasonal' ELSE 'sequential' END AS strategy FROM s1 JOIN ok USING (series_id))"""


@query("f2_seasonal_split", rounded(f"WITH {DAILY}, {SEASONAL.format('daily')} SELECT * FROM split", "load"))
def f2(spark, sf):
    return splits.seasonal_split(daily(spark, sf), DAY)


@query("f2_seasonal_fallback", rounded(f"WITH {HOURLY}, {SEASONAL.format('hourly')} SELECT * FROM split", "load"))
def f2_fallback(spark, sf):
    return splits.seasonal_split(hourly(spark, sf), HOUR)


SEGMENTS = """b AS (SELECT *, lag(ts) OVER w AS pt, (role <> lag(role) OVER w OR season <> lag(season) OVER w OR epoch(ts) - epoch(lag(ts) OVER w) > 1.5 * 86400)::INT AS brk
  FROM split WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
g AS (SELECT *, sum(coalesce(brk, 0)) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM b),
segs AS (SELECT series_id, island, role, season, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM g GROUP BY ALL)"""


@query("f3_segments", f"WITH {BY_FLAG}, {SEASONAL.format('by_flag')}, {SEGMENTS} SELECT * FROM segs")
def f3(spark, sf):
    return splits.segments(splits.seasonal_split(shipped_by_flag(spark, sf), DAY), DAY)


@query("f4_segment_summary", f"""
WITH {BY_FLAG}, {SEASONAL.format('by_flag')}, c AS (SELECT series_id, season, count(*) FILTER (WHERE role = 'training') AS training, count(*) FILTER (WHERE role = 'validation') AS validation FROM split GROUP BY ALL),
t AS (SELECT * FROM c UNION ALL SELECT series_id, 'total', sum(training)::BIGINT, sum(validation)::BIGINT FROM c GROUP BY ALL)
SELECT *, round(validation / (training + validation), 4) + 0.0 AS validation_fraction FROM t""")
def f4(spark, sf):
    return splits.segment_summary(splits.segments(splits.seasonal_split(shipped_by_flag(spark, sf), DAY), DAY))


@query("f5_role_codes", rounded(f"""
WITH {DAILY}, {SEASONAL.format('daily')} SELECT series_id, ts, load, CASE role WHEN 'training' THEN 0 ELSE 1 END::BIGINT AS role_code FROM split""", "load"))
def f5(spark, sf):
    return splits.role_codes(splits.seasonal_split(daily(spark, sf), DAY)).select("series_id", "ts", "load", "role_code")


@query("f6_split_strategy", f"""
WITH {DAILY}, {SEASONAL.format('daily')},
b AS (SELECT *, (role <> lag(role) OVER w OR epoch(ts) - epoch(lag(ts) OVER w) > 1.5 * 86400)::INT AS brk FROM split WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
g AS (SELECT *, sum(coalesce(brk, 0)) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS chunk FROM b)
SELECT series_id, role, 'seasonal' AS strategy, count(*) AS n_steps, 0::BIGINT AS n_interpolated, count(DISTINCT chunk) AS n_chunks FROM g GROUP BY ALL""")
def f6(spark, sf):
    return splits.prepare_training(daily(spark, sf), DAY)[1]

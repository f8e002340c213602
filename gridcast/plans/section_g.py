"""Supervised rows, forecasters, fleets and search (inventory G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridcast.operators import baselines, fleet, intervals, learners, metrics, origins, splits, trees
from gridcast.operators.covariates import merge_covariates
from gridcast.operators.grid import chunks
from gridcast.plans.base import (
    ACTIVITY, DAILY, DAY, HOUR, HOURLY, activity, daily, filled_sql, hourly, origins_sql, query, rounded, scored_sql,
)
from gridcast.plans.section_cd import naive, scored, with_future_rows
from gridcast.plans.section_ef import CHUNKS, SEQ


def grid_of(spark, sf):
    return fleet.prepare(hourly(spark, sf), HOUR)


@query("g1_supervised_rows", rounded(f"""
WITH {HOURLY}, {filled_sql('hourly')}, w AS (SELECT series_id, ts, lag(load, 24) OVER w AS x_first, lag(load, 1) OVER w AS x_last,
  avg(load) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS x_mean, load AS y_first, lead(load, 5) OVER w AS y_last
  FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT * FROM w WHERE x_first IS NOT NULL AND y_last IS NOT NULL""", "x_first x_last x_mean y_first y_last"))
def g1(spark, sf):
    d = origins.supervised(grid_of(spark, sf), HOUR, 24, 6)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / 24
    return d.select("series_id", "ts", F.col("x")[0].alias("x_first"), F.col("x")[23].alias("x_last"), mean.alias("x_mean"),
                    F.col("y")[0].alias("y_first"), F.col("y")[5].alias("y_last"))


@query("g2_rolling_origins", f"""
WITH {HOURLY}, {filled_sql('hourly')}, {origins_sql(24, 24, 6)} SELECT series_id, origin_ts, i AS origin_idx FROM origins""")
def g2(spark, sf):
    return origins.rolling_origins(grid_of(spark, sf), HOUR, 24, 24, stride=6)


@query("g2_last_points", rounded(f"""
WITH {HOURLY}, {scored_sql(stride=1)} SELECT series_id, origin_ts, h, ts, yhat, actual FROM scored WHERE h = 24""", "yhat actual"))
def g2_last(spark, sf):
    grid, f = naive(spark, sf, stride=1)
    return metrics.score(f.where("h = 24"), grid).drop("model")


STEPS = "CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS h) x"


@query("g3_naive_mean", rounded(f"""
WITH {HOURLY}, {filled_sql('hourly')}, {origins_sql(24, 24, 24)},
m AS (SELECT *, avg(load) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS yhat FROM idx)
SELECT o.series_id, 'NaiveMean' AS model, o.origin_ts, h, o.origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts, yhat
FROM origins o JOIN m USING (series_id, i) {STEPS}""", "yhat"))
def g3(spark, sf):
    return baselines.expanding_mean(grid_of(spark, sf), HOUR, 24, 24)


@query("g4_naive_seasonal", rounded(f"WITH {HOURLY}, {scored_sql()} SELECT series_id, model, origin_ts, h, ts, yhat FROM scored", "yhat"))
def g4(spark, sf):
    return naive(spark, sf)[1]


@query("g4_rolling_seasonal", rounded(f"WITH {HOURLY}, {scored_sql(stride=5, horizon=30, period=12)} SELECT * FROM scored", "yhat actual"))
def g4_rolling(spark, sf):
    return baselines.rolling_seasonal(grid_of(spark, sf), HOUR, 24, 30, stride=5, period=12)


@query("g5_moving_average", rounded(f"""
WITH RECURSIVE {HOURLY}, {filled_sql('hourly')}, {origins_sql(24, 24, 24)},
b AS (SELECT *, list(load) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS buf FROM idx),
r AS (SELECT o.series_id, o.origin_ts, 0::BIGINT AS h, buf, NULL::DOUBLE AS yhat FROM origins o JOIN b USING (series_id, i)
  UNION ALL SELECT series_id, origin_ts, h + 1, list_append(buf[2:], list_avg(buf)), list_avg(buf) FROM r WHERE h < 24)
SELECT series_id, 'NaiveMovingAverage' AS model, origin_ts, h, origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts, yhat FROM r WHERE h > 0""", "yhat"))
def g5(spark, sf):
    return baselines.moving_average(grid_of(spark, sf), HOUR, 24, 24)


@query("g6_linear_one_lag", rounded(f"""
WITH {HOURLY}, {filled_sql('hourly')}, {origins_sql(1, 3, 3)},
p AS (SELECT series_id, i, lag(load) OVER w AS x, load AS y1, lead(load, 1) OVER w AS y2, lead(load, 2) OVER w AS y3 FROM idx WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
q AS (SELECT p.* FROM p JOIN (SELECT series_id, min(i) AS s FROM origins GROUP BY ALL) USING (series_id) WHERE x IS NOT NULL AND i + 2 < s),
c AS (SELECT series_id, 1::BIGINT AS h, regr_slope(y1, x) AS a, regr_intercept(y1, x) AS b FROM q GROUP BY ALL
  UNION ALL SELECT series_id, 2, regr_slope(y2, x), regr_intercept(y2, x) FROM q GROUP BY ALL
  UNION ALL SELECT series_id, 3, regr_slope(y3, x), regr_intercept(y3, x) FROM q GROUP BY ALL)
SELECT o.series_id, 'LinearRegression' AS model, o.origin_ts, h, o.origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts, b + a * x AS yhat
FROM origins o JOIN p USING (series_id, i) JOIN c USING (series_id)""", "yhat"))
def g6_one(spark, sf):
    return fleet.forecast(grid_of(spark, sf), HOUR, "LinearRegression", 1, 3, calendar_static=False)


@query("g7_boosted_trees", f"""
WITH {HOURLY}, {filled_sql('hourly')}, {origins_sql(24, 24, 24)}
SELECT series_id, 'GradientBoosting' AS model, origin_ts, h, origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts, true AS in_range FROM origins o {STEPS}""")
def g7(spark, sf):
    """Every step of every origin with the defaults, fitted before the first origin; forecasts lie in the range of the load."""
    g = grid_of(spark, sf)
    f = fleet.forecast(g, HOUR, "GradientBoosting", 24, 24)
    span = g.groupBy("series_id").agg(F.min("load").alias("lo"), F.max("load").alias("hi"))
    return f.join(span, "series_id").withColumn("in_range", F.col("yhat").between(F.col("lo"), F.col("hi"))).drop("yhat", "lo", "hi")


@query("g7_learning_curve", """
SELECT 'h' || h AS model_id, 40::BIGINT AS rounds, true AS falls, true AS covers_validation FROM (SELECT unnest(generate_series(1, 24)) AS h)""")
def g7_curve(spark, sf):
    """The training loss of a round is never above that of the round before."""
    rows = fleet._windows(grid_of(spark, sf), HOUR, 24, 24, None, True).where(F.size("y") == 24)
    models = trees.fit_boosted(rows.where("fit_ok"), 24)
    curve = trees.learning_curve(models, rows.where("fit_ok"), rows.where("not fit_ok"), 24)
    before = F.lag("train").over(Window.partitionBy("model_id").orderBy("x"))
    checked = curve.withColumn("_ok", F.coalesce(F.col("train") <= before + 1e-9, F.lit(True)))
    return checked.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("rounds"), F.bool_and("_ok").alias("falls"), F.bool_and(F.col("val").isNotNull()).alias("covers_validation")
    )


@query("g8_autoregression", rounded(f"""
WITH RECURSIVE {HOURLY}, {filled_sql('hourly')}, {origins_sql(24, 24, 24)},
z AS (SELECT series_id, ts, i, load, load - lag(load) OVER (PARTITION BY series_id ORDER BY ts) AS z FROM idx),
l AS (SELECT *, lag(z) OVER w AS z1, lag(load) OVER w AS l1 FROM z WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
c AS (SELECT series_id, regr_slope(z, z1) AS a, regr_intercept(z, z1) AS b
  FROM l JOIN (SELECT series_id, min(i) AS s FROM origins GROUP BY ALL) USING (series_id) WHERE i < s GROUP BY ALL),
r AS (SELECT o.series_id, o.origin_ts, 0::BIGINT AS h, z1 AS z, l1 AS yhat, a, b FROM origins o JOIN l USING (series_id, i) JOIN c USING (series_id)
  UNION ALL SELECT series_id, origin_ts, h + 1, b + a * z, yhat + b + a * z, a, b FROM r WHERE h < 24)
SELECT series_id, 'ARIMA' AS model, origin_ts, h, origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts, yhat FROM r WHERE h > 0""", "yhat"))
def g8(spark, sf):
    return baselines.autoregression(grid_of(spark, sf), HOUR, 24, 1, 1, lookback=24)


@query("g9_residual_correction", rounded(f"""
WITH {HOURLY}, {ACTIVITY}, {scored_sql()}, a AS (SELECT s.*, coalesce(n_events, 0) AS x, actual - yhat AS r FROM scored s LEFT JOIN activity USING (ts)),
m AS (SELECT series_id, avg(x) AS mx, stddev_pop(x) AS sx, avg(r) AS mr FROM a WHERE origin_ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
w AS (SELECT series_id, mx, sx, mr, sum((x - mx) / sx * r) / (sum(((x - mx) / sx) ** 2) + 1) AS w FROM a JOIN m USING (series_id) WHERE origin_ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT series_id, model || '+Residual' AS model, origin_ts, h, ts, yhat + mr + w * (x - mx) / sx AS yhat, yhat AS base_yhat FROM a JOIN w USING (series_id)""", "yhat base_yhat"))
def g9(spark, sf):
    grid, f = naive(spark, sf)
    r = merge_covariates(grid.drop("_blk", "interpolated"), activity(spark, sf), ["n_events"]).fillna(0.0, ["n_events"])
    return learners.residual_correction(f, r, ["n_events"], F.col("origin_ts") < F.lit("2024-01-20").cast("timestamp_ntz"))


BANDS = f"""early AS (SELECT *, actual - yhat AS e FROM scored WHERE origin_ts < TIMESTAMP '2024-01-20'),
rq AS (SELECT series_id, h, quantile_cont(e, 0.1) AS r1, quantile_cont(e, 0.5) AS r5, quantile_cont(e, 0.9) AS r9 FROM early GROUP BY ALL),
banded AS (SELECT s.series_id, s.model, s.origin_ts, s.h, s.ts, s.yhat + r5 AS yhat, s.actual, s.yhat + r1 AS q0_1, s.yhat + r5 AS q0_5, s.yhat + r9 AS q0_9
  FROM scored s JOIN rq USING (series_id, h) WHERE origin_ts >= TIMESTAMP '2024-01-20')"""


def banded(spark, sf):
    s = scored(spark, sf, stride=6)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    q = intervals.residual_quantiles(s.where(F.col("origin_ts") < cut), [0.9, 0.1])
    return intervals.add_bands(s.where(F.col("origin_ts") >= cut), q, [0.1, 0.9])


@query("g10_forecast_bands", rounded(f"WITH {HOURLY}, {scored_sql(stride=6)}, {BANDS} SELECT * FROM banded", "yhat actual q0_1 q0_5 q0_9"))
def g10(spark, sf):
    return banded(spark, sf)


@query("g11_rows_within_chunks", rounded(f"""
WITH {DAILY}, {CHUNKS}, w AS (SELECT series_id, ts, chunk_id, lag(load, 3) OVER w AS x_first, lag(load) OVER w AS x_last, load AS y_first, lead(load) OVER w AS y_last
  FROM chunked WINDOW w AS (PARTITION BY series_id, chunk_id ORDER BY ts))
SELECT * FROM w WHERE x_first IS NOT NULL AND y_last IS NOT NULL""", "x_first x_last y_first y_last"))
def g11(spark, sf):
    d = origins.supervised(chunks(daily(spark, sf), DAY), DAY, 3, 2)
    return d.select("series_id", "ts", "chunk_id", F.col("x")[0].alias("x_first"), F.col("x")[2].alias("x_last"),
                    F.col("y")[0].alias("y_first"), F.col("y")[1].alias("y_last"))


@query("g12_train_runs", rounded(f"""
WITH {HOURLY}, {scored_sql(fraction=0.0)}, {SEQ.format('filled').replace('i AS (', 'q AS (').replace('FROM i)', 'FROM q)')},
m AS (SELECT s.series_id, role, 100 * sqrt(avg((actual - yhat) ** 2)) / avg(actual) AS cv FROM scored s JOIN split p ON p.series_id = s.series_id AND p.ts = s.origin_ts GROUP BY ALL)
SELECT f.series_id, 'NaiveSeasonal' AS model_type, 'h' AS frequency, 24::BIGINT AS lookback, 24::BIGINT AS horizon, min(f.ts) AS train_start, max(f.ts) AS train_end, count(*) AS n_rows,
  (SELECT cv FROM m WHERE m.series_id = f.series_id AND role = 'training') AS train_cv_rmse, (SELECT cv FROM m WHERE m.series_id = f.series_id AND role = 'validation') AS cv_rmse
FROM filled f GROUP BY ALL""", "train_cv_rmse cv_rmse"))
def g12(spark, sf):
    r = fleet.train_fleet(hourly(spark, sf), HOUR, "NaiveSeasonal", 24, 24)["runs"]
    return r.select("series_id", "model_type", "frequency", "lookback", "horizon", "train_start", "train_end", "n_rows", "train_cv_rmse", "cv_rmse")


PERIODS = {"period": {"type": "categorical", "choices": [12, 24, 48, 168]}}


def _searched_sql() -> str:
    """The validation CV-RMSE of each drawn period, over all series."""
    rows = []
    for trial, params in enumerate(fleet.drawn(PERIODS, 4, 42)):
        p = params["period"]
        rows.append(f"""SELECT {trial}::BIGINT AS trial, '{{"period":"{p}"}}' AS params, (WITH {HOURLY}, {scored_sql(lookback=max(24, p), period=p, fraction=0.0)},
  {SEQ.format('filled').replace('i AS (', 'q AS (').replace('FROM i)', 'FROM q)')}, v AS (SELECT series_id, min(ts) AS v0 FROM split WHERE role = 'validation' GROUP BY ALL)
  SELECT 100 * sqrt(avg((actual - yhat) ** 2)) / avg(actual) FROM scored JOIN v USING (series_id) WHERE origin_ts >= v0) AS cv_rmse""")
    return " UNION ALL ".join(rows)


@query("g14_parameter_search", rounded(_searched_sql(), "cv_rmse"))
def g14(spark, sf):
    t = fleet.tune(hourly(spark, sf), HOUR, "NaiveSeasonal", 24, 24, PERIODS, n_trials=4)
    return t.select("trial", F.to_json("params").alias("params"), "cv_rmse")


def searched(spark, sf, model):
    """The declared space of the model, the default number of trials: every trial is scored, and the best is the least score."""
    t = fleet.tune(hourly(spark, sf), HOUR, model, 24, 24)
    least = t.agg(F.min("cv_rmse")).scalar()
    best = fleet.best_trial(t).select(F.col("cv_rmse").alias("best"))
    return t.join(best).select("trial", F.size("params").alias("n_params"), (F.col("cv_rmse") > 0).alias("scored"), (F.col("best") == least).alias("best_is_least"))


def _searched_rows(n_params: int) -> str:
    return f"SELECT trial, {n_params}::BIGINT AS n_params, true AS scored, true AS best_is_least FROM (SELECT unnest(range(20)) AS trial)"


@query("g14_arima_search", _searched_rows(2))
def g14_arima(spark, sf):
    return searched(spark, sf, "ARIMA")


@query("g14_tree_search", _searched_rows(5))
def g14_trees(spark, sf):
    return searched(spark, sf, "GradientBoosting")


@query("g14_arima_fits", rounded(f"""
WITH {HOURLY}, {filled_sql('hourly')}, {SEQ.format('filled')},
z AS (SELECT *, load - lag(load) OVER (PARTITION BY series_id ORDER BY ts) AS z FROM split),
l AS (SELECT *, lag(load) OVER w AS x0, lag(load, 6) OVER w AS y0, lag(z) OVER w AS x1, lag(z, 6) OVER w AS y1 FROM z WINDOW w AS (PARTITION BY series_id ORDER BY ts))
SELECT series_id, 0::BIGINT AS d, regr_intercept(load, x0) AS intercept, regr_slope(load, x0) AS slope FROM l WHERE role = 'training' AND y0 IS NOT NULL GROUP BY ALL
UNION ALL SELECT series_id, 1, regr_intercept(z, x1), regr_slope(z, x1) FROM l WHERE role = 'training' AND y1 IS NOT NULL GROUP BY ALL""", "intercept slope"))
def g14_fits(spark, sf):
    """All twelve orders from one pass per difference; those with one lag are shown."""
    split = splits.sequential_split(grid_of(spark, sf), HOUR)
    fits = baselines.fit_autoregressions(split, HOUR, [(p, d) for p in range(1, 7) for d in (0, 1)], F.col("role") == "training")
    return fits.where("p = 1").select("series_id", "d", F.col("w")[0].alias("intercept"), F.col("w")[1].alias("slope"))


FAIL = """n AS (SELECT series_id, count(*) AS c FROM hourly GROUP BY ALL)"""


@query("g16_fleet_summary", f"""
WITH {HOURLY}, {FAIL} SELECT count(*) AS total, count(*) FILTER (WHERE c >= 675) AS succeeded, count(*) FILTER (WHERE c < 675) AS failed FROM n""")
def g16(spark, sf):
    return fleet.train_fleet(hourly(spark, sf), HOUR, "NaiveMean", 551, 24)["summary"]


@query("g16_fleet_failures", f"WITH {HOURLY}, {FAIL} SELECT series_id, printf('%d rows, %d needed', c, 675) AS error FROM n WHERE c < 675")
def g16_failures(spark, sf):
    return fleet.split_failures(hourly(spark, sf), 551, 24)[1]


def _forward(source: str, extra: str = "") -> str:
    return f"""{filled_sql(source)}, lastk AS (SELECT series_id, max(ts) + INTERVAL 1 HOUR AS origin_ts FROM {source} WHERE load IS NOT NULL GROUP BY ALL),
ahead AS (SELECT *, origin_ts + (h - 1) * INTERVAL 1 HOUR AS ts FROM lastk CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS h) x)"""


@query("g17_fleet_forecast", rounded(f"""
WITH {HOURLY}, {_forward('hourly')} SELECT a.series_id, 'NaiveSeasonal' AS model, origin_ts, h, a.ts, f.load AS yhat
FROM ahead a JOIN filled f ON f.series_id = a.series_id AND f.ts = a.ts - INTERVAL 24 HOUR""", "yhat"))
def g17(spark, sf):
    return fleet.forward_forecast(hourly(spark, sf), HOUR, 24)


@query("g18_forward_forecast", rounded(f"""
WITH {HOURLY}, known_load AS (SELECT series_id, ts, load FROM hourly WHERE ts < TIMESTAMP '2024-01-27'), {_forward('known_load')},
m AS (SELECT series_id, avg(load) AS yhat FROM filled GROUP BY ALL)
SELECT a.series_id, 'NaiveMean' AS model, origin_ts, h, a.ts, yhat FROM ahead a JOIN m USING (series_id)""", "yhat"))
def g18(spark, sf):
    return fleet.forward_forecast(with_future_rows(spark, sf), HOUR, 24, "NaiveMean")


@query("g18_missing_future", f"""
WITH {HOURLY}, {ACTIVITY}, w AS (SELECT h.series_id, h.ts, CASE WHEN h.ts < TIMESTAMP '2024-01-27' THEN load END AS load, CASE WHEN n_events < 15 THEN n_events END AS n_events FROM hourly h LEFT JOIN activity USING (ts)),
o AS (SELECT series_id, max(ts) + INTERVAL 1 HOUR AS o FROM w WHERE load IS NOT NULL GROUP BY ALL),
a AS (SELECT series_id, o + h * INTERVAL 1 HOUR AS ts FROM o CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h) x)
SELECT series_id, count(*) FILTER (WHERE n_events IS NULL) AS n_missing, printf('%d of %d future rows missing', count(*) FILTER (WHERE n_events IS NULL), 24) AS error
FROM a LEFT JOIN w USING (series_id, ts) GROUP BY ALL HAVING count(*) FILTER (WHERE n_events IS NULL) > 0""")
def g18_missing(spark, sf):
    d = merge_covariates(with_future_rows(spark, sf), activity(spark, sf), ["n_events"])
    d = d.withColumn("n_events", F.when(F.col("n_events") < 15, F.col("n_events")))
    return fleet.missing_future(d, HOUR, 24, ["n_events"])

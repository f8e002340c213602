"""One query per table of the backtest, evaluation and exploration reports, and properties of fitted models (inventory G, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.functions.blocks import attach
from gridcast.operators import features, fleet, learners, metrics, profile, reports, splits
from gridcast.operators.covariates import merge_covariates
from gridcast.plans.base import (
    ACTIVITY, DAY, HOUR, HOURLY, METRIC_COLUMNS, METRIC_SQL, ORACLES, activity, filled_sql, hourly, query, rounded, scored_sql,
)
from gridcast.plans.section_cd import scored, with_future_rows
from gridcast.plans.section_ef import SEQ
from gridcast.plans.section_g import STEPS, _forward, grid_of
from gridcast.plans.section_ik import with_shipments

# -- tables of a backtest --------------------------------------------------------------------------------------------

ROLLED = scored_sql(stride=12, lookback=48)


def again(name: str, before: str, after: str, *more: tuple[str, str]) -> str:
    """The SQL of another query over another backtest."""
    sql = ORACLES[name]
    for a, b in ((before, after), *more):
        if a not in sql:
            raise ValueError(f"{name}: nothing to replace")
        sql = sql.replace(a, b)
    return sql


def backtested(spark, sf):
    return fleet.backtest(hourly(spark, sf), HOUR, "NaiveSeasonal", 48, 24, stride=12, levels=[0.1, 0.9])


BLOCKS = {
    "windows": again("h12_window_metrics", scored_sql(stride=6), ROLLED),
    "horizon": again("h6_horizon_metrics", scored_sql(), ROLLED),
    "residuals": again("h5_residual_diagnostics", scored_sql(stride=6), ROLLED),
    "peak_days": again("h4_peak_days", scored_sql(stride=6), ROLLED),
    "peaks": again("h4_peak_summary", scored_sql(stride=6), ROLLED),
    "summary": again("h14_backtest_summary", scored_sql(stride=6), ROLLED, ("6::BIGINT AS stride", "12::BIGINT AS stride")),
    "forecasts": again("d6_score_join", scored_sql(), ROLLED),
}


def _block(name: str, sql: str) -> None:
    @query(f"h15_{name}", sql)
    def h15_block(spark, sf):
        return backtested(spark, sf)[name]


for _name, _sql in BLOCKS.items():
    _block(_name, _sql)

HALVES = f"""e AS (SELECT *, min(origin_ts) OVER (PARTITION BY series_id) AS a, max(origin_ts) OVER (PARTITION BY series_id) AS b FROM scored),
early AS (SELECT *, actual - yhat AS e FROM e WHERE origin_ts <= a + (b - a) / 2), late AS (SELECT * FROM e WHERE origin_ts > a + (b - a) / 2),
rq AS (SELECT series_id, h, quantile_cont(e, 0.1) AS r1, quantile_cont(e, 0.5) AS r5, quantile_cont(e, 0.9) AS r9 FROM early GROUP BY ALL),
banded AS (SELECT s.series_id, s.model, s.origin_ts, s.h, s.ts, s.actual, s.yhat + r1 AS q0_1, s.yhat + r5 AS q0_5, s.yhat + r9 AS q0_9 FROM late s JOIN rq USING (series_id, h))"""


@query("h15_backtest_intervals", rounded(f"""
WITH {HOURLY}, {ROLLED}, {HALVES}
SELECT series_id, avg((greatest(0.1::DOUBLE * (actual - q0_1), -0.9::DOUBLE * (actual - q0_1)) + 0.5::DOUBLE * abs(actual - q0_5) + greatest(0.9::DOUBLE * (actual - q0_9), -0.1::DOUBLE * (actual - q0_9))) / 3) AS pinball_loss,
  avg((actual BETWEEN q0_1 AND q0_9)::INT) AS coverage, 0.8::DOUBLE AS nominal_coverage, avg(q0_9 - q0_1) AS mean_width FROM banded GROUP BY ALL""", "pinball_loss coverage nominal_coverage mean_width"))
def h15_intervals(spark, sf):
    """Bands from the residuals of the first half of the windows, scored on the rest."""
    return backtested(spark, sf)["intervals"]


@query("h15_coverage", rounded(f"""
WITH {HOURLY}, {ROLLED}, {HALVES} SELECT series_id, model, h, avg((actual BETWEEN q0_1 AND q0_9)::INT) AS coverage, avg(q0_9 - q0_1) AS mean_width, count(*) AS n FROM banded GROUP BY ALL""", "coverage mean_width"))
def h15_coverage(spark, sf):
    return backtested(spark, sf)["coverage"]


# -- tables of a backtest report -------------------------------------------------------------------------------------

REPORTED = scored_sql(stride=12)


def reported(spark, sf):
    return reports.backtest_report(scored(spark, sf, stride=12), HOUR, 12)


REPORT_BLOCKS = {
    "windows": again("h12_window_metrics", scored_sql(stride=6), REPORTED),
    "residuals": again("h5_residual_diagnostics", scored_sql(stride=6), REPORTED),
    "summary": again("h14_backtest_summary", scored_sql(stride=6), REPORTED, ("6::BIGINT AS stride", "12::BIGINT AS stride")),
    "metrics": rounded(f"WITH {HOURLY}, {REPORTED} SELECT series_id, model, {METRIC_SQL} FROM scored GROUP BY ALL", METRIC_COLUMNS),
}


def _report_block(name: str, sql: str) -> None:
    @query(f"i17_{name}", sql)
    def i17_block(spark, sf):
        return reported(spark, sf)[name]


for _name, _sql in REPORT_BLOCKS.items():
    _report_block(_name, _sql)


# -- tables of a data report -----------------------------------------------------------------------------------------


def explored(spark, sf):
    return reports.data_report(with_shipments(spark, sf), DAY, ["quantity", "discount"])


REPORT_TABLES = {"peak_windows": "i9_peak_windows", "correlation": "i4_covariate_correlation", "relation_quantity": "i7_relation_curve"}


def _table(name: str, like: str) -> None:
    @query(f"i10_{name}", ORACLES[like])
    def i10_table(spark, sf):
        return explored(spark, sf)[name]


for _name, _like in REPORT_TABLES.items():
    _table(_name, _like)


@query("i10_series", again("f5_role_codes", "WITH", "WITH"))
def i10_series(spark, sf):
    return explored(spark, sf)["series"].select("series_id", "ts", "load", "role_code")


@query("i8_scatter_sample", """
WITH q AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts FROM orders GROUP BY ALL),
s AS (SELECT DISTINCT date_trunc('day', l_shipdate) AS ts FROM lineitem), n AS (SELECT series_id, count(*) AS known FROM q JOIN s USING (ts) GROUP BY ALL)
SELECT series_id, least(known, 500)::BIGINT AS n_rows, least(known, 500)::BIGINT AS n_times, true AS members FROM n""")
def i8(spark, sf):
    """A sample's rows are rows of its table, each once, and as many as asked for."""
    d = with_shipments(spark, sf)
    sample = profile.scatter_sample(d, "quantity", 500)
    own = d.select("series_id", "ts", F.col("load").alias("_y"), F.col("quantity").cast("double").alias("_x"))
    met = sample.join(own, ["series_id", "ts"], "left")
    member = (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.hour("ts") == F.col("hour"))
    return met.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ts").alias("n_times"), F.bool_and(F.coalesce(member, F.lit(False))).alias("members")
    )


# -- properties of fitted models -------------------------------------------------------------------------------------


@query("e15_training_noise", f"""
WITH {HOURLY}, {ACTIVITY}, j AS (SELECT h.*, n_events FROM hourly h JOIN activity USING (ts)), {SEQ.format('j')}
SELECT series_id, ts, role, role = 'training' AS changed FROM split""")
def e15(spark, sf):
    """Noise changes the covariate of every training row and of no other."""
    s = splits.sequential_split(hourly(spark, sf).join(activity(spark, sf), "ts"), HOUR)
    noisy = features.add_noise(s.withColumn("before", F.col("n_events")), {"n_events": 0.5})
    return noisy.select("series_id", "ts", "role", (F.col("n_events") != F.col("before")).alias("changed"))


def orthogonal(rows, coef, width: int):
    """Per series and step: rows fitted, and whether the residuals have mean zero and are orthogonal to every feature."""
    d = attach(rows, coef, ["series_id"])
    y = F.element_at("y", F.col("h").cast("int"))
    d = d.select("series_id", "h", "x", (y - learners.dot(F.col("w"), F.col("x"))).alias("e"), y.alias("t"))
    scale = F.sqrt(F.sum(F.col("t") * F.col("t")))
    tests = [F.abs(F.sum(F.col("e") * F.col("x")[i])) <= 1e-6 * scale * F.sqrt(F.sum(F.col("x")[i] * F.col("x")[i])) for i in range(width)]
    mean_zero = F.abs(F.sum("e")) <= 1e-6 * scale * F.sqrt(F.count(F.lit(1)))
    every = tests[0]
    for t in tests[1:]:
        every = every & t
    return d.groupBy("series_id", "h").agg(F.count(F.lit(1)).alias("n_rows"), mean_zero.alias("mean_zero"), every.alias("orthogonal"))


@query("g6_normal_equations", f"""
WITH {HOURLY}, {filled_sql('hourly')}, n AS (SELECT series_id, count(*) AS n FROM filled GROUP BY ALL)
SELECT series_id, h, (greatest(24, floor(n * 0.2::DOUBLE)) - 24 - 24 + 1)::BIGINT AS n_rows, true AS mean_zero, true AS orthogonal FROM n {STEPS}""")
def g6(spark, sf):
    """24 lags and 24 steps: the normal equations hold on the rows before the first origin."""
    rows = fleet._windows(grid_of(spark, sf), HOUR, 24, 24, None, False).where("fit_ok")
    return orthogonal(rows.select("series_id", "x", "y"), learners.fit_linear(rows, ["series_id"]), 24)


@query("g6_linear_regression", f"""
WITH {HOURLY}, {scored_sql()} SELECT series_id, count(*) AS n, true AS finite FROM scored GROUP BY ALL""")
def g6_metrics(spark, sf):
    """24 lags and 24 steps with calendar features, fitted before the first origin, forecast and scored."""
    g = grid_of(spark, sf)
    m = metrics.point_metrics(metrics.score(fleet.forecast(g, HOUR, "LinearRegression", 24, 24), g))
    return m.select("series_id", "n", (F.col("rmse").isNotNull() & (F.col("rmse") < 1e6)).alias("finite"))


@query("g9_temperature_correction", rounded(f"""
WITH {HOURLY}, {scored_sql()} SELECT series_id, model || '+Residual' AS model, origin_ts, h, ts, yhat AS base_yhat, true AS fit_mean_zero FROM scored""", "base_yhat"))
def g9_temperature(spark, sf):
    """Degree and spline features: the corrected residuals of the fitted rows have mean zero."""
    from gridcast.operators.features import temperature_knots

    grid = grid_of(spark, sf)
    f = fleet.forecast(grid, HOUR, "NaiveSeasonal", 24, 24).drop("actual")
    names = ["n_events", "max_value"]
    r = merge_covariates(grid.drop("_blk", "interpolated"), activity(spark, sf), names).fillna(0.0, names)
    train = F.col("origin_ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    out = learners.residual_correction(f, r, names, train, temperature="max_value", knots=temperature_knots(r, "max_value"))
    means = metrics.score(out.where(train), grid).groupBy("series_id").agg((F.abs(F.avg(F.col("actual") - F.col("yhat"))) < 1e-6).alias("fit_mean_zero"))
    return out.join(means, "series_id").drop("yhat")


@query("g18_forward_linear", f"""
WITH {HOURLY}, known_load AS (SELECT series_id, ts, load FROM hourly WHERE ts < TIMESTAMP '2024-01-27'), {_forward('known_load')}
SELECT series_id, 'LinearRegression' AS model, origin_ts, h, ts, true AS in_range FROM ahead""")
def g18_linear(spark, sf):
    """All 24 steps; forecasts lie within the range of the load, widened by its length to both sides."""
    d = with_future_rows(spark, sf)
    f = fleet.forward_forecast(d, HOUR, 24, "LinearRegression", calendar_static=False)
    span = d.groupBy("series_id").agg(F.min("load").alias("lo"), F.max("load").alias("hi"))
    wide = F.col("yhat").between(2 * F.col("lo") - F.col("hi"), 2 * F.col("hi") - F.col("lo"))
    return f.join(span, "series_id").withColumn("in_range", wide).drop("yhat", "lo", "hi")

"""Registry of queries and the reading tables they share.

Each query is a function ``(spark, sf_dir) -> DataFrame`` registered with the
SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.functions.blocks import BLK
from gridcast.session import DEFAULTS
from gridcast.sources.readings import read_parquet, resample

HOUR, DAY = 3600, 86400
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form: rounded doubles, 64-bit integers, no helper columns."""
    out = []
    for f in df.schema.fields:
        if f.name == BLK:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = steady_round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


# Exact halves are common in means of cents; a shifted rounding point keeps two
# engines on the same side of them.
ROUND_AT, ROUND_LIMIT = 0.503, 9e11


def steady_round(c, digits: int):
    unit = float(10**digits)
    return F.when(F.abs(c) < ROUND_LIMIT, F.floor(c * unit + ROUND_AT) / unit).otherwise(c)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query under its inventory id and the SQL equal to it."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", DEFAULTS["spark.sql.session.timeZone"])
            return present(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def rounded(sql: str, columns: str, digits: int = 6) -> str:
    """Round the named columns of a SELECT the way :func:`present` does."""
    unit = f"1e{digits}"
    body = ", ".join(
        f'CASE WHEN abs("{c}") < {ROUND_LIMIT} THEN floor("{c}" * {unit} + {ROUND_AT}) / {unit} ELSE "{c}" END AS "{c}"'
        for c in columns.split()
    )
    return f"SELECT * REPLACE ({body}) FROM ({sql})"


# -- reading tables --------------------------------------------------------------------------


def events(spark, sf, *columns) -> DataFrame:
    return read_parquet(spark, f"{sf}/events.parquet", columns or None)


def raw_events(spark, sf) -> DataFrame:
    """Readings at their raw times: one row per event."""
    return events(spark, sf, "event_id", "event_type", "ts", "value").select(
        F.col("event_type").alias("series_id"), "ts", F.col("value").alias("load"), "event_id"
    )


def hourly(spark, sf) -> DataFrame:
    """Hourly load per event type."""
    return resample(events(spark, sf, "event_type", "ts", "value"), "hour", "sum", "value", "event_type").withColumn(
        "load", F.round("load", 6)
    )


def holed(spark, sf) -> DataFrame:
    """Hourly load where small values count as missing."""
    return hourly(spark, sf).withColumn("load", F.when(F.col("load") >= 10, F.col("load")))


def daily(spark, sf) -> DataFrame:
    """Daily revenue in thousands per order priority."""
    d = read_parquet(spark, f"{sf}/orders.parquet", ["o_orderdate", "o_totalprice", "o_orderpriority"])
    return resample(d, "day", "sum", "o_totalprice", "o_orderpriority", "o_orderdate").withColumn(
        "load", F.round(F.col("load") / 1000, 6)
    )


def shipped(spark, sf) -> DataFrame:
    """Daily quantity and total discount over all shipments: a shared covariate."""
    d = read_parquet(spark, f"{sf}/lineitem.parquet", ["l_shipdate", "l_quantity", "l_discount"])
    return d.groupBy(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_discount"), 6).alias("discount")
    )


def shipped_by_flag(spark, sf) -> DataFrame:
    """Daily shipped quantity per return flag."""
    d = read_parquet(spark, f"{sf}/lineitem.parquet", ["l_shipdate", "l_quantity", "l_returnflag"])
    return resample(d, "day", "sum", "l_quantity", "l_returnflag", "l_shipdate")


def activity(spark, sf) -> DataFrame:
    """Hourly number of events over all types: a shared hourly covariate."""
    return events(spark, sf, "ts", "value").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"), F.round(F.max("value"), 6).alias("max_value")
    )


# The same tables in SQL.
HOURLY = """hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 6) AS load
  FROM events GROUP BY ALL)"""
HOLED = HOURLY + """, holed AS (
  SELECT series_id, ts, CASE WHEN load >= 10 THEN load END AS load FROM hourly)"""
DAILY = """daily AS (
  SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
         round(sum(o_totalprice) / 1000, 6) AS load
  FROM orders GROUP BY ALL)"""
SHIPPED = """shipped AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS quantity,
         round(sum(l_discount), 6) AS discount
  FROM lineitem GROUP BY ALL)"""
BY_FLAG = """by_flag AS (
  SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS load
  FROM lineitem GROUP BY ALL)"""
ACTIVITY = """activity AS (
  SELECT date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS n_events, round(max(value), 6) AS max_value
  FROM events GROUP BY ALL)"""


def grid_sql(source: str, step: str = "HOUR", name: str = "grid") -> str:
    """CTE: the source on a regular grid."""
    return f"""{name}_span AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM {source} GROUP BY ALL),
{name}_t AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 {step})) AS ts FROM {name}_span),
{name} AS (SELECT t.series_id, t.ts, s.load FROM {name}_t t LEFT JOIN {source} s USING (series_id, ts))"""


def known_sql(source: str, name: str = "known", value: str = "load") -> str:
    """CTE: nearest known value behind and ahead."""
    back = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    t = f"CASE WHEN {value} IS NOT NULL THEN ts END"
    return f"""{name} AS (SELECT *,
  last_value({t} IGNORE NULLS) {back} AS pt, last_value({value} IGNORE NULLS) {back} AS pv,
  first_value({t} IGNORE NULLS) {ahead} AS nt, first_value({value} IGNORE NULLS) {ahead} AS nv
  FROM {source})"""


LINE = "pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt))"


def filled_sql(source: str, step: str = "HOUR") -> str:
    """CTEs ending in ``filled``: grid, then filling in both directions."""
    return f"""{grid_sql(source, step)}, {known_sql('grid')},
filled AS (SELECT series_id, ts, CASE WHEN load IS NOT NULL THEN load
  WHEN pt IS NOT NULL AND nt IS NOT NULL THEN {LINE} ELSE coalesce(pv, nv) END AS load FROM known)"""


def origins_sql(lookback: int, horizon: int, stride: int, fraction: float = 0.2) -> str:
    """CTEs ``idx`` and ``origins`` over ``filled``."""
    return f"""idx AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY series_id) AS n FROM filled),
origins AS (SELECT series_id, ts AS origin_ts, i FROM (
  SELECT *, greatest({lookback}, floor(n * {fraction}::DOUBLE))::BIGINT AS s FROM idx)
  WHERE i >= s AND (i - s) % {stride} = 0 AND i + {horizon} <= n)"""


def scored_sql(source: str = "hourly", step: str = "HOUR", lookback: int = 24, horizon: int = 24, stride: int = 24, period: int = 24, fraction: float = 0.2) -> str:
    """CTEs ending in ``scored``: the seasonal naive backtest of a source."""
    return f"""{filled_sql(source, step)}, {origins_sql(lookback, horizon, stride, fraction)},
steps AS MATERIALIZED (SELECT series_id, origin_ts, h, i + h - 1 AS ti, i - {period} + (h - 1) % {period} AS si
  FROM (SELECT *, unnest(generate_series(1, {horizon})) AS h FROM origins)),
scored AS (SELECT f.series_id, 'NaiveSeasonal' AS model, f.origin_ts, f.h, t.ts, s.load AS yhat, t.load AS actual
  FROM steps f JOIN idx t ON t.series_id = f.series_id AND t.i = f.ti
  JOIN idx s ON s.series_id = f.series_id AND s.i = f.si)"""


METRIC_SQL = """count(*) AS n, sqrt(avg((actual - yhat) ** 2)) AS rmse, avg(abs(actual - yhat)) AS mae,
  100 * avg(CASE WHEN actual <> 0 THEN abs((actual - yhat) / actual) END) AS mape,
  100 * sqrt(avg((actual - yhat) ** 2)) / avg(actual) AS cv_rmse,
  1 - sum((actual - yhat) ** 2) / (count(*) * var_pop(actual)) AS r_squared"""
METRIC_COLUMNS = "rmse mae mape cv_rmse r_squared"

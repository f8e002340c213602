"""One series, time or file may hold a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.functions import blocks
from gridcast.operators import fleet, metrics, outliers, profile
from gridcast.sources import readings
from gridcast.streaming import live
from tests.helpers import frame, pandas_of

HOUR = 3600


@pytest.fixture
def hot(spark):
    """A series of 30,000 hours beside 60 series of 1,000."""
    t0 = F.lit("2000-01-01").cast("timestamp_ntz")
    long = spark.range(30000).select(F.lit("hot").alias("series_id"), "id")
    short = spark.range(60000).select(F.concat(F.lit("s"), (F.col("id") % 60).cast("string")).alias("series_id"), F.floor(F.col("id") / 60).alias("id"))
    return long.unionByName(short).select(
        "series_id", (t0 + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"),
        (100 + 10 * F.sin(F.col("id") / 24 * 2 * np.pi) + F.pmod(F.xxhash64("series_id", "id"), F.lit(100)) / 100).alias("load"),
    )


def largest_group(df, *keys):
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_no_window_group_exceeds_a_block(spark, hot):
    grid = fleet.prepare(hot, HOUR)
    assert grid.count() == 90000
    assert largest_group(grid, "series_id", "_blk") <= blocks.BLOCK_STEPS
    halo = blocks.haloed(grid, blocks.block_seconds(HOUR, 168), before=168 * HOUR)
    assert largest_group(halo, "series_id", "_blk") <= 8 * 168 + 168
    assert halo.where("_own").count() == 90000


def test_windows_never_partition_rows_by_series_alone(spark, hot):
    """Every window over rows is keyed by block; those keyed by the series
    alone run over block summaries."""
    grid = fleet.prepare(hot, HOUR)
    f = fleet.forecast(grid, HOUR, "NaiveSeasonal", 24, 24)
    plan = f._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "row_number" in line or "lag(" in line:
            assert "_blk" in line


def test_attach_spreads_a_hot_key(spark, hot):
    facts = hot.groupBy("series_id").agg(F.avg("load").alias("m"))
    got = blocks.attach(hot, facts, ["series_id"])
    assert got.count() == 90000
    salt = F.pmod(F.xxhash64("series_id", "ts", "load"), F.lit(blocks.SALTS))
    top = largest_group(hot.withColumn("s", salt), "series_id", "s")
    assert top < 2 * 30000 / blocks.SALTS


def test_results_do_not_depend_on_partitioning(spark, hot):
    a = metrics.point_metrics(fleet.forecast(fleet.prepare(hot, HOUR), HOUR, "NaiveSeasonal", 24, 24))
    b = metrics.point_metrics(fleet.forecast(fleet.prepare(hot.repartition(13), HOUR), HOUR, "NaiveSeasonal", 24, 24))
    x, y = pandas_of(a, "series_id"), pandas_of(b, "series_id")
    assert len(x) == 61 and np.allclose(x.drop(columns="series_id"), y.drop(columns="series_id"))


def test_repeated_time_combines_before_the_shuffle(spark):
    t = pd.Timestamp("2024-01-01")
    df = spark.range(20000).select(
        F.lit("a").alias("series_id"), F.lit(t.to_pydatetime()).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("load"), F.col("id").alias("n")
    )
    d = readings.deduplicate(df, "n")
    assert d.first().asDict() == {"series_id": "a", "ts": t.to_pydatetime(), "load": 0.0, "n": 0, "n_copies": 20000}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_top_rows_are_cut_per_task(spark, hot):
    d = outliers.top_by(hot, F.abs("load"), 5)
    assert "WindowGroupLimit" in d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 61 * 5


def test_percentiles_of_a_hot_series(spark, hot):
    got = blocks.exact_percentiles(hot.where("series_id = 'hot'"), ["series_id"], "load", {"p": 0.37}).first()["p"]
    want = np.percentile([r["load"] for r in hot.where("series_id = 'hot'").collect()], 37)
    assert np.isclose(got, want)


def test_filters_and_columns_reach_the_scan(spark):
    from gridcast.plans import QUERIES

    plan = QUERIES["a4_parquet_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "user_id" not in plan.split("ReadSchema")[1]


# -- streaming ---------------------------------------------------------------------------------


def write(spark, path, rows):
    spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, load double").coalesce(1).write.mode("append").parquet(path)


def test_late_readings_are_dropped_and_steps_close_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    day = pd.Timestamp("2024-01-01")

    def run():
        s = spark.readStream.schema("series_id string, ts timestamp_ntz, load double").parquet(src)
        live.write_load(live.regular_load(s), out, ck).awaitTermination()
        return pandas_of(spark.read.parquet(out))

    write(spark, src, [("a", (day + pd.Timedelta(minutes=10 * i)).to_pydatetime(), 1.0) for i in range(6 * 8)])
    first = run()
    assert (first["load"] == 6).all() and first["ts"].max() < day + pd.Timedelta("6h")
    write(spark, src, [("a", day.to_pydatetime(), 99.0), ("a", (day + pd.Timedelta("12h")).to_pydatetime(), 1.0)])
    second = run()
    assert second["ts"].is_unique and second[second.ts == day]["load"].tolist() == [6.0]
    assert len(second) > len(first)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table, out = str(tmp_path / "t"), str(tmp_path / "f")
    t = pd.date_range("2024-01-01", periods=60, freq="h")
    df = frame(spark, pd.DataFrame({"series_id": "a", "ts": t, "load": np.arange(60.0)}))
    live.score_batch(df, 0, table, out, HOUR, 6)
    one = pandas_of(live.latest_forecasts(spark, out), "h")
    live.score_batch(df, 0, table, out, HOUR, 6)
    two = pandas_of(live.latest_forecasts(spark, out), "h")
    assert one.equals(two) and one["yhat"].tolist() == [36.0 + i for i in range(6)]

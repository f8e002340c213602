"""Sources, roles, windows, checks, covariates, registry."""

import os
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from __spark_entry__ import oracle_sql, queries
from gridcast.operators import checks, covariates, features, intervals, outliers, profile, reports, roles, splits, timefilter
from gridcast.sources import catalog, readings, registry, weather
from tests.helpers import frame, holed_series, pandas_of
from tests.oracle import TABLES, compare

HOUR = 3600


def test_catalog_lists_and_profiles_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    rows = "timestamp,load_kwh,outdoor_temp\n" + "".join(f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00,{100 + i % 24},5\n" for i in range(240))
    for p in ("b.csv", "sub/A.csv", ".hidden/c.csv"):
        (tmp_path / p).write_text(rows + "bad,1,1\n")
    (tmp_path / "notes.txt").write_text("x")
    got = catalog.list_datasets(spark, str(tmp_path), limit=1).collect()
    assert [r["relative_path"] for r in got] == ["b.csv"] and got[0]["n_total"] == 2 and got[0]["truncated"]
    with pytest.raises(ValueError):
        catalog.list_datasets(spark, str(tmp_path), limit=0)
    assert [r["relative_path"] for r in catalog.list_datasets(spark, str(tmp_path)).collect()] == ["b.csv", "sub/A.csv"]
    assert catalog.list_datasets(spark, str(tmp_path), max_depth=0).count() == 1
    (tmp_path / "sub/b.csv").write_text(rows)
    same = readings.read_csv(spark, str(tmp_path), "timestamp string, load_kwh double, outdoor_temp double")
    named = {r["file"]: r["n_rows"] for r in catalog.profile_files(same, "timestamp", str(tmp_path)).collect()}
    assert named["b.csv"] == named["sub/b.csv"] + 1
    df = readings.read_csv(spark, str(tmp_path / "b.csv"), "timestamp string, load_kwh double, outdoor_temp double")
    p = catalog.profile_files(df, "timestamp").first()
    assert (p["n_rows"], p["n_unparseable"], p["frequency"]) == (241, 1, "h")
    assert p["max_ts"] == datetime(2024, 1, 10, 23)


def test_folders_of_part_files_are_one_dataset(spark, tmp_path):
    root = tmp_path / "data"
    rows = spark.range(12).select("id", F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 2).alias("k"))
    rows.repartition(3, "id").write.parquet(str(root / "a b+c%20.parquet"))     # spread by hash: only all files together are hourly
    rows.write.partitionBy("k").parquet(str(root / "sub/data/results"))         # keys in folders, no suffix
    rows.coalesce(1).write.option("header", True).csv(str(root / "sub/t.csv"))
    for p in ("one.parquet", "sub/data/one.parquet"):                            # the directory's name again below it
        rows.limit(5).toPandas().to_parquet(root / p)
    (root / "a b+c%20.parquet/venv").mkdir()
    (root / "a b+c%20.parquet/venv/x.parquet").write_bytes((root / "one.parquet").read_bytes())
    listed = catalog.list_datasets(spark, f"file://{root}").join(catalog.file_rows(spark, f"file://{root}"), ["relative_path", "format"], "left").collect()
    want = {"a b+c%20.parquet": 12, "one.parquet": 5, "sub/data/one.parquet": 5, "sub/data/results": 12, "sub/t.csv": None}
    assert {r["relative_path"]: r["n_rows"] for r in listed} == want and {r["n_total"] for r in listed} == {5}
    sizes = {r["relative_path"]: r["size_bytes"] for r in listed}
    assert sizes["sub/data/results"] == sum(p.stat().st_size for p in (root / "sub/data/results").rglob("part-*"))
    direct = ["a b+c%20.parquet", "one.parquet"]
    assert [r["relative_path"] for r in catalog.list_datasets(spark, str(root), recursive=False).collect()] == direct
    assert [r["relative_path"] for r in catalog.list_datasets(spark, str(root / "sub/data/results")).collect()] == ["."]
    scan = spark.read.parquet(str(root / direct[0]))
    for directory in (None, str(root)):
        p = catalog.profile_files(scan, "ts", directory).collect()
        assert [(r["file"], r["n_rows"], r["max_ts"], r["frequency"]) for r in p] == [(direct[0], 12, datetime(1970, 1, 1, 11), "h")]


def test_catalog_query_counts_tables_in_parts(spark, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(2).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("a1_dataset_catalog", "a2_dataset_profile"):
        assert compare(spark, con, queries()[name], oracle_sql()[name], str(tmp_path)) is None


def test_catalog_query_counts_empty_tables_below_any_spelling_of_the_path(spark, tmp_path):
    con = duckdb.connect()
    (tmp_path / "data").mkdir()
    for t in TABLES:
        kept = "false" if t in ("events", "labels") else "true"
        con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet' WHERE {kept}) TO '{tmp_path}/data/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/data/{t}.parquet'")
    for path in (f"{tmp_path}/data", f"{tmp_path}/data/../data/.", f"file://{tmp_path}/./data/"):
        assert compare(spark, con, queries()["a1_dataset_catalog"], oracle_sql()["a1_dataset_catalog"], path) is None


def test_empty_csv_is_an_error(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(readings.DataLoadError):
        readings.read_csv(spark, str(tmp_path / "e.csv"), "a string, b string")


def test_corrupt_lines_are_kept(spark):
    lines = spark.createDataFrame([("1,2.5",), ("x,y",)], "line string")
    schema = T.StructType.fromDDL("a int, b double")
    got = readings.parse_csv_lines(lines, "line", schema).collect()
    assert got[0]["_corrupt"] is None and got[1]["_corrupt"] == "x,y"


def test_strict_timestamps_fail_and_nan_becomes_null(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00+02:00", float("nan")), ("bad", 1.0)], "t string, v double")
    lenient = readings.with_parsed_ts(df, "t", strict=False).collect()
    assert lenient[0]["ts"] == datetime(2023, 12, 31, 22) and lenient[1]["ts"] is None
    with pytest.raises(Exception, match="unparseable"):
        readings.with_parsed_ts(df, "t").collect()
    assert readings.nan_to_null(df).first()["v"] is None


def test_wide_to_long_names_missing_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "ts int, a double")
    with pytest.raises(readings.DataLoadError, match="b"):
        readings.wide_to_long(df, "ts", ["a", "b"])


def test_weather_payload(spark):
    body = '{"hourly": {"time": ["2024-01-01T01:00", "2024-01-01T00:00Z"], "temperature_2m": [1.5, null], "cloud_cover": [3, 4]}}'
    df = spark.createDataFrame([(body,)], "p string")
    got = pandas_of(weather.unpack_weather(df, "p", ["temperature_2m", "rain"]), "ts")
    assert got.columns.tolist() == ["ts", "temperature", "rain"]
    assert got["ts"].tolist() == [pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-01 01:00")]
    assert got["temperature"][1] == 1.5 and got["rain"].isna().all()
    assert [r["variable"] for r in weather.absent_variables(df, "p", ["temperature_2m", "rain"]).collect()] == ["rain"]
    assert weather.unknown_variables(["rain", "cape", "nonsense"]) == ["nonsense"]
    assert [len(v) for v in weather.PRESETS.values()] == [2, 7, 13]


def test_role_detection(spark):
    schema = "ts string, load_forecast double, site_load_kw double, T_out double, Weather_Code int, is_holiday int, Is_Daytime int, misc_signal double"
    df = spark.createDataFrame([("2023-06-01 00:00", 1.0, 2.0, 3.0, 4, 0, 1, 5.0)], schema)
    r = roles.detect_roles(df)
    assert (r.datetime, r.target, r.past, r.excluded) == ("ts", "site_load_kw", ["T_out"], ["load_forecast"])
    hints = {(h["column_name"], h["hint"]) for h in roles.role_hints(df, r).collect()}
    assert ("is_holiday", "future_covariate_candidate") in hints and ("Weather_Code", "categorical_code") in hints
    with pytest.raises(readings.DataLoadError):
        roles.validate_roles(df, roles.ColumnRoles("ts", "absent"))
    kept, gone = roles.validate_roles(df, roles.ColumnRoles("ts", "site_load_kw", ["T_out", "x"]))
    assert kept.past == ["T_out"] and gone == ["x"]
    assert roles.temperature_column(["lag_temp", "T_out", "Temperature"]) == "Temperature"


def test_date_windows(spark):
    with pytest.raises(timefilter.WindowError):
        timefilter.DateWindow("2024-01-02", "2024-01-01")
    with pytest.raises(timefilter.WindowError):
        timefilter.DateWindow("never")
    t = pd.date_range("2024-01-01", periods=96, freq="30min")
    df = frame(spark, pd.DataFrame({"series_id": "a", "ts": t, "load": 1.0}))
    assert timefilter.filter_window(df, timefilter.DateWindow("2024-01-01", "2024-01-01")).count() == 48
    assert timefilter.filter_window(df, timefilter.DateWindow(None, "2024-01-01 10:00")).count() == 21
    assert timefilter.filter_window(df, timefilter.DateWindow("2024-01-01T12:00:00+02:00")).count() == 76


def test_backtest_start_errors(spark):
    df = frame(spark, pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=50, freq="h"), "load": 1.0}))
    early = timefilter.backtest_start(df, HOUR, 24, date="2024-01-01 05:00").first()
    assert early["error"] == "earliest valid start is 2024-01-02 00:00:00"
    assert timefilter.backtest_start(df, HOUR, 60).first()["error"] == "not enough data"
    assert "after" in timefilter.backtest_start(df, HOUR, 24, date="2025-01-01").first()["error"]
    with pytest.raises(ValueError):
        timefilter.backtest_start(df, HOUR, 24, 0.2, "2024-01-02")


def test_fall_back_and_spring_gap(spark):
    zone = "America/Los_Angeles"
    t = pd.date_range("2021-11-07 07:00", periods=6, freq="h")
    cov = frame(spark, pd.DataFrame({"ts": t, "T_out": np.arange(6.0)}), "ts timestamp_ntz, T_out double")
    local = covariates.unique_times(covariates.convert_clock(cov, "UTC", zone).drop("clock_issue"))
    assert local.count() == 5 and local.agg(F.sum(F.col("n_copies") - 1)).first()[0] == 1
    one = {r["ts"].hour: r["T_out"] for r in local.collect()}
    assert one[1] == 1.0  # the first of the two
    t = pd.date_range("2021-03-14 08:00", periods=5, freq="h")
    cov = frame(spark, pd.DataFrame({"ts": t, "T_out": np.arange(5.0)}), "ts timestamp_ntz, T_out double")
    load = frame(spark, pd.DataFrame({"series_id": "a", "ts": pd.date_range("2021-03-14", periods=6, freq="h"), "load": 1.0}))
    merged = covariates.merge_covariates(load, covariates.unique_times(covariates.convert_clock(cov, "UTC", zone).drop("clock_issue")))
    filled = pandas_of(covariates.fill_covariates(merged, ["T_out"]))
    assert filled["was_missing"].sum() == 1 and filled["T_out"].tolist() == [0, 1, 1, 2, 3, 4]
    back = covariates.convert_clock(frame(spark, pd.DataFrame({"ts": [pd.Timestamp("2021-03-14 02:30")]}), "ts timestamp_ntz"), zone, "UTC")
    assert back.first()["clock_issue"] == "nonexistent"


def test_merge_refuses_clashes_and_unknown_columns(spark):
    load = frame(spark, pd.DataFrame({"series_id": ["a"], "ts": [pd.Timestamp("2024-01-01")], "load": [1.0]}))
    with pytest.raises(readings.DataLoadError):
        covariates.merge_covariates(load, load.drop("series_id"))
    with pytest.raises(readings.DataLoadError):
        covariates.merge_covariates(load, load.select("ts", F.col("load").alias("x")), ["y"])


def test_merge_report_stops_finer_covariates(spark):
    load = frame(spark, pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=48, freq="h"), "load": 1.0}))
    fine = frame(spark, pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=192, freq="15min"), "x": 1.0}), "ts timestamp_ntz, x double")
    r = covariates.merge_report(load, fine, ["x"], "fine").first()
    assert r["verdict"] == "stop" and r["stop_reason"] == "finer than load"


def test_missing_policies(spark):
    df = frame(spark, holed_series(60))
    assert checks.apply_missing_policy(df, "drop", HOUR).where("load is null").count() == 0
    assert checks.apply_missing_policy(df, "interpolate", HOUR).where("load is null").count() == 0
    with pytest.raises(Exception, match="missing values"):
        checks.apply_missing_policy(df, "error", HOUR).collect()
    with pytest.raises(readings.DataLoadError):
        checks.apply_missing_policy(df, "guess", HOUR)


def test_flags_of_a_clean_series_and_of_a_broken_one(spark):
    t = pd.date_range("2024-01-01", periods=300, freq="h")
    pdf = pd.DataFrame({"series_id": "a", "ts": t, "load": 50 + 5 * np.sin(np.arange(300) / 24 * 2 * np.pi)})
    p = checks.series_profile(frame(spark, pdf), HOUR)
    f = checks.quality_flags(p)
    # the spike rule compares steps with the spread of steps, so a smooth sine crosses it
    assert [r["flag"] for r in f.collect()] == ["SPIKE"] and checks.readiness(p, f).first()["ready"]
    bad = pdf.copy()
    bad["ts"] += pd.Timedelta("60D") + pd.Timedelta("16h")
    bad.loc[:2, "load"] = -5.0
    bad.loc[100:, "ts"] += pd.Timedelta("4h")
    bad = pd.concat([bad, bad.head(5)])
    flags = {r["flag"] for r in checks.quality_flags(checks.series_profile(frame(spark, bad), HOUR), "30min").collect()}
    assert {"FREQUENCY_MISMATCH", "DUPLICATES", "GAPS", "NEGATIVE_TARGET", "POSSIBLE_UTC", "DST_MERGE_RISK", "SPIKE"} <= flags


@pytest.mark.parametrize("freq,seconds,label", [("15min", 900, "15min"), ("30min", 1800, "30min"), ("h", 3600, "h"), ("D", 86400, None)])
def test_cadences(spark, freq, seconds, label):
    df = frame(spark, pd.DataFrame({"series_id": "a", "ts": pd.date_range("2023-01-01", periods=400, freq=freq), "load": 1.0}))
    assert checks.infer_frequency(df).first()["frequency"] == label
    lagged = pandas_of(features.lag_features(df, seconds, (24,)))
    assert lagged["lag_ready"].sum() == 400 - max(1, 86400 // seconds)


def test_scaler_sees_training_rows_only(spark):
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=100, freq="h"), "load": np.arange(100.0)})
    s = splits.sequential_split(frame(spark, pdf), HOUR)
    p = features.fit_scaler(s, ["load"])
    assert p.first()["hi"] == 79.0
    got = pandas_of(features.scale(s, p, ["load"]))
    assert got["load"].min() == 0 and got["load"].max() > 1


def test_noise_is_repeatable_and_for_training_only(spark):
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=4000, freq="h"), "load": 0.0})
    s = splits.sequential_split(frame(spark, pdf), HOUR).withColumn("c", F.lit(10.0))
    a, b = pandas_of(features.add_noise(s, {"c": 2.0})), pandas_of(features.add_noise(s.repartition(5), {"c": 2.0}))
    assert a["c"].equals(b["c"]) and (a[a.role == "validation"]["c"] == 10).all()
    noise = a[a.role == "training"]["c"] - 10
    assert abs(noise.mean()) < 0.15 and abs(noise.std() - 2) < 0.15


def test_flat_series_has_no_spikes(spark):
    v = np.full(200, 100.0) + np.where(np.arange(200) % 50 == 0, 1e-4, 0)
    df = frame(spark, pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=200, freq="h"), "load": v}))
    assert outliers.spikes(df, HOUR).count() == 0


def test_scatter_sample_is_bounded_and_stable(spark):
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=900, freq="h"), "load": np.arange(900.0)})
    df = frame(spark, pdf).withColumn("x", F.col("load") * 2)
    one, two = (pandas_of(profile.scatter_sample(d, "x", 100)) for d in (df, df.repartition(7)))
    assert len(one) == 100 and one.equals(two)
    assert profile.relation_curve(df.withColumn("x", F.lit(1.0)), "x").count() == 0


def test_curves(spark):
    rows = [("over", 1, 5.0, 4.0), ("over", 2, 3.0, 2.0), ("over", 3, 1.0, 3.0), ("under", 1, 5.0, 5.0), ("under", 2, 4.0, 4.0), ("under", 3, 3.0, 3.0), ("none", 1, 1.0, None)]
    got = {r["model_id"]: r for r in reports.curve_diagnostics(spark.createDataFrame(rows, "model_id string, x int, train double, val double")).collect()}
    assert got["over"]["over_trained"] and got["over"]["best_x"] == 2 and got["over"]["gap_ratio"] == 3.0
    assert got["under"]["still_improving"] and not got["under"]["over_trained"] and got["none"]["best_x"] is None


def test_registry_round_trip(spark, tmp_path):
    r = registry.RunRegistry(spark, os.path.join(str(tmp_path), "runs"))
    assert r.list().count() == 0
    base = spark.sql("""SELECT * FROM VALUES ('m1', 'A', 'ARIMA', 3.0D, timestamp_ntz'2024-01-01 00:00:00'), ('m2', 'A', 'NaiveMean', 0.0D, timestamp_ntz'2024-01-02 00:00:00'),
      ('m3', 'B', 'ARIMA', CAST(NULL AS DOUBLE), timestamp_ntz'2024-01-03 00:00:00') t(model_id, building, model_type, cv_rmse, created_at)""")
    r.save(base)
    assert [x["model_id"] for x in r.list().collect()] == ["m3", "m2", "m1"]
    assert [x["model_id"] for x in r.list(sort_by="cv_rmse").collect()] == ["m2", "m1", "m3"]
    assert [x["n_total"] for x in r.list(building="A", limit=1).collect()] == [2]
    r.delete("m2")
    assert [x["model_id"] for x in r.list().collect()] == ["m3", "m1"]


def test_sink_splits_a_large_series_only(spark, tmp_path):
    large = spark.range(4000).select(F.lit("a").alias("series_id"), F.col("id").cast("double").alias("load"))
    small = spark.range(160).select(F.concat(F.lit("s"), F.col("id") % 20).alias("series_id"), F.col("id").cast("double").alias("load"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        readings.write_results(large.union(small), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d: sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "out" / d)) for d in os.listdir(tmp_path / "out") if "=" in d}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4160
    assert files.pop("series_id=a") > 1 and len(files) == 20
    assert set(files.values()) == {1}


def test_bands_of_overlapping_windows(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    p = spark.createDataFrame([("a", at(5), 1.0), ("a", at(6), 2.0)], "series_id string, ts timestamp_ntz, yhat double")
    b = spark.createDataFrame([("a", at(1), at(5), 0.1), ("a", at(2), at(5), None)], "series_id string, origin_ts timestamp_ntz, ts timestamp_ntz, lo double")
    got = intervals.attach_quantiles(p, b, ["lo"]).orderBy("ts").collect()
    assert [(r["yhat"], r["lo"]) for r in got] == [(1.0, None), (2.0, None)]
    assert intervals.attach_quantiles(p, b.where("lo > 0").drop("origin_ts"), ["lo"]).orderBy("ts").first()["lo"] == 0.1
    with pytest.raises(Exception, match="several bands"):
        intervals.attach_quantiles(p, b.drop("origin_ts"), ["lo"]).collect()

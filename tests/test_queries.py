"""Registered queries against their SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# The quickest query of each family; `python -m tests.oracle` runs all of them.
NAMES = (
    "a3_csv_lines", "a5_wide_to_long", "a6_result_sink", "a7_weather_payload", "a9_run_registry", "b1_role_detection",
    "b6_deduplicate", "b8_frequency_inference", "b19_quality_flags", "c2_buffered_lags", "c6_backtest_start",
    "d2_clock_issues", "d4_fill_covariates", "d6_score_join", "e2_interpolate", "e4_gap_report", "e8_lag_features",
    "e16_value_outliers", "f2_seasonal_split", "f4_segment_summary", "g4_rolling_seasonal", "g5_moving_average",
    "g6_linear_one_lag", "g8_autoregression", "g10_forecast_bands", "h1_metric_sets", "h4_peak_days",
    "h5_residual_diagnostics", "h8_interval_metrics", "i1_column_statistics", "i5_load_profiles", "k1_live_load",
    "a3_csv_files", "a6_bucketed_sink", "e1_duplicates", "e1_off_grid", "e15_training_noise", "g7_boosted_trees", "g14_arima_fits", "g16_job_settings", "g17_forward_bands", "g6_one_covariate", "h16_stored_run", "i8_scatter_sample",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], SF) is None


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["series_id", "model", "h", "n", "rmse", "mae", "mape"] and df.count() > 0

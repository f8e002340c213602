"""Block-wise operators against plain pandas, with blocks of eight steps."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.functions import blocks
from gridcast.functions.time import epoch
from gridcast.operators import baselines, features, grid, origins, outliers, splits
from tests.helpers import frame, holed_series, pandas_of

HOUR = 3600


@pytest.fixture
def data(spark, tiny_blocks):
    pdf = holed_series()
    return frame(spark, pdf), pdf


def blocked(df):
    return blocks.blocked(df, 8 * HOUR)


def test_row_index(data):
    df, pdf = data
    got = pandas_of(blocks.row_index(blocked(df), "i", "n"))
    assert (got["i"] == pdf.groupby("series_id").cumcount()).all()
    assert (got["n"] == pdf.groupby("series_id")["ts"].transform("size")).all()


def test_previous_ts_and_running_total(data):
    df, pdf = data
    got = pandas_of(blocks.previous_ts(blocked(df)))
    assert got["prev_ts"].equals(pdf.groupby("series_id")["ts"].shift()) or (
        got["prev_ts"].fillna(pd.Timestamp(0)) == pdf.groupby("series_id")["ts"].shift().fillna(pd.Timestamp(0))
    ).all()
    v = F.coalesce("load", F.lit(0.0))
    got = pandas_of(blocks.running_total(blocked(df), v, "s"))
    want = pdf.assign(load=pdf["load"].fillna(0)).groupby("series_id")["load"].cumsum()
    assert np.allclose(got["s"], want)


def test_nearest_known(data):
    df, pdf = data
    got = pandas_of(blocks.nearest_known(blocked(df), "load"))
    assert np.allclose(got["_pv"].astype(float), pdf.groupby("series_id")["load"].ffill(), equal_nan=True)
    assert np.allclose(got["_nv"].astype(float), pdf.groupby("series_id")["load"].bfill(), equal_nan=True)


def regular(pdf):
    parts = []
    for name, p in pdf.groupby("series_id"):
        s = p.set_index("ts")["load"]
        s = s.reindex(pd.date_range(s.index.min(), s.index.max(), freq="h"))
        parts.append(pd.DataFrame({"series_id": name, "ts": s.index, "load": s.to_numpy()}))
    return pd.concat(parts, ignore_index=True)


def test_grid_and_interpolation(data):
    df, pdf = data
    want = regular(pdf)
    g = grid.regular_grid(df, HOUR)
    got = pandas_of(g)
    assert (got["ts"] == want["ts"]).all() and np.allclose(got["load"].astype(float), want["load"], equal_nan=True)
    filled = pandas_of(grid.interpolate(g, HOUR))
    expect = want.groupby("series_id", group_keys=False)["load"].apply(
        lambda s: pd.Series(s.to_numpy(), index=pd.date_range("2024-01-01", periods=len(s), freq="h")).interpolate("time").reset_index(drop=True)
    )
    assert np.allclose(filled["load"].astype(float), expect.to_numpy(), equal_nan=True)
    assert pandas_of(grid.fill_all(g, HOUR))["load"].notna().all()


def test_grid_drops_off_grid_rows_and_keeps_single_row_series(spark, tiny_blocks):
    t = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({
        "series_id": ["a", "a", "a", "b"],
        "ts": [t, t + pd.Timedelta("90min"), t + pd.Timedelta("20h"), t], "load": [1.0, 2.0, 3.0, 4.0],
    })
    got = pandas_of(grid.regular_grid(frame(spark, pdf), HOUR))
    assert len(got[got.series_id == "a"]) == 21 and got[got.series_id == "a"]["load"].notna().sum() == 2
    assert len(got[got.series_id == "b"]) == 1


def test_max_gap_leaves_long_holes(spark, tiny_blocks):
    t = pd.date_range("2024-01-01", periods=30, freq="h")
    v = np.arange(30.0)
    v[5] = np.nan
    v[10:20] = np.nan
    df = frame(spark, pd.DataFrame({"series_id": "a", "ts": t, "load": v}))
    got = pandas_of(grid.interpolate(df, HOUR, max_gap_seconds=2 * HOUR))
    assert got["load"][5] == 5.0 and got["load"][10:20].isna().all()


def test_chunks_gaps_and_islands(data):
    df, pdf = data
    gap = pdf.groupby("series_id")["ts"].diff() > pd.Timedelta("1h")
    want = gap.astype(int).groupby(pdf["series_id"]).cumsum()
    got = pandas_of(grid.chunks(df, HOUR))
    assert (got["chunk_id"] == want).all()
    assert pandas_of(grid.chunk_spans(df, HOUR), "series_id", "chunk_id")["n_rows"].sum() == len(pdf)
    g = pandas_of(grid.gaps(df, HOUR), "series_id", "first_after")
    delta = pdf.groupby("series_id")["ts"].diff()[gap]
    assert sorted(g["missing_steps"]) == sorted((delta / pd.Timedelta("1h")).round().astype(int) - 1)


def test_lags_use_time_on_the_grid(data):
    df, pdf = data
    g = regular(pdf)
    g["f"] = g.groupby("series_id")["load"].ffill()
    got = pandas_of(features.lag_features(grid.regular_grid(df, HOUR), HOUR, (3, 24)))
    first = pdf.dropna().groupby("series_id")["load"].first()
    for h in (3, 24):
        want = g.groupby("series_id")["f"].shift(h)
        want = want.fillna(g["series_id"].map(first))
        assert np.allclose(got[f"lag_{h}h"].astype(float), want)
    assert (got["lag_ready"] == (g.groupby("series_id").cumcount() >= 24)).all()


def test_lags_do_not_see_the_future(data):
    df, pdf = data
    changed = df.withColumn("load", F.when(F.col("ts") > F.lit("2024-01-04").cast("timestamp_ntz"), F.col("load") * 7).otherwise(F.col("load")))
    cut = pd.Timestamp("2024-01-04")
    a = pandas_of(features.lag_features(grid.regular_grid(df, HOUR), HOUR, (3, 24)))
    b = pandas_of(features.lag_features(grid.regular_grid(changed, HOUR), HOUR, (3, 24)))
    cols = ["lag_3h", "lag_24h"]
    assert np.allclose(a[a.ts <= cut][cols].astype(float), b[b.ts <= cut][cols].astype(float))


def test_steps_and_thinning(data):
    df, pdf = data
    known = pdf.dropna().reset_index(drop=True)
    got = pandas_of(outliers.steps(df, HOUR))
    assert np.allclose(got["step"].astype(float), known.groupby("series_id")["load"].diff(), equal_nan=True)
    thin = pandas_of(outliers.thin(df, HOUR, 10))
    assert thin.groupby("series_id").size().max() <= 10


def dated(n=900, names=("a", "b")):
    t = pd.date_range("2022-01-10", periods=n, freq="D")
    return pd.concat([pd.DataFrame({"series_id": s, "ts": t, "load": np.arange(n) + 1.0}) for s in names], ignore_index=True)


def season_of(ts):
    return {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer"}.get(ts.month, "fall")


def test_seasonal_split_and_segments(spark, tiny_blocks):
    pdf = dated()
    got = pandas_of(splits.seasonal_split(frame(spark, pdf), 86400))
    pdf["season"] = pdf["ts"].map(season_of)
    k = pdf.groupby(["series_id", "season"])
    want = np.where(k.cumcount() < np.floor(k["ts"].transform("size") * 0.8), "training", "validation")
    assert (got["role"] == want).all() and set(got["strategy"]) == {"seasonal"}
    segs = pandas_of(splits.segments(splits.seasonal_split(frame(spark, pdf[["series_id", "ts", "load"]]), 86400), 86400), "series_id", "start_ts")
    change = (pd.Series(want) != pd.Series(want).shift()) | (pdf["season"] != pdf["season"].shift()) | (pdf["series_id"] != pdf["series_id"].shift())
    assert len(segs) == change.sum() and segs["n_rows"].sum() == len(pdf)


def test_split_falls_back_without_all_seasons(spark, tiny_blocks):
    pdf = dated(60)
    got = pandas_of(splits.seasonal_split(frame(spark, pdf), 86400))
    assert set(got["strategy"]) == {"sequential"}
    assert (got.groupby("series_id").cumcount() < 48).eq(got["role"] == "training").all()


def clean(spark, n=100):
    pdf = holed_series(n, drop=0, null=0)
    return frame(spark, pdf), pdf


def test_supervised_windows(spark, tiny_blocks):
    df, pdf = clean(spark)
    got = pandas_of(origins.supervised(df, HOUR, 5, 3))
    for name, p in pdf.groupby("series_id"):
        v = p["load"].to_numpy()
        g = got[got.series_id == name]
        assert len(g) == len(v) - 5 - 3 + 1
        for i, (_, row) in zip(range(5, len(v) - 2), g.iterrows()):
            assert np.allclose(row["x"], v[i - 5:i]) and np.allclose(row["y"], v[i:i + 3])


def test_supervised_keeps_training_windows_inside_the_part(spark, tiny_blocks):
    df, pdf = clean(spark)
    d = df.withColumn("role", F.when(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz"), "training").otherwise("validation"))
    got = pandas_of(origins.supervised(d, HOUR, 5, 3))
    assert (got["fit_ok"] == (got["ts"] + pd.Timedelta("2h") < pd.Timestamp("2024-01-04"))).all()


def naive_rows(pdf, lookback, horizon, stride, k):
    out = []
    for name, p in pdf.groupby("series_id"):
        v, t = p["load"].to_numpy(), p["ts"].to_numpy()
        n = len(v)
        for i in range(max(lookback, int(0.2 * n)), n - horizon + 1, stride):
            for h in range(1, horizon + 1):
                out.append((name, t[i], h, v[i - k + (h - 1) % k], v[i + h - 1], v[:i].mean(), v[i - lookback:i]))
    return out


@pytest.mark.parametrize("stride,horizon,k", [(6, 6, 6), (1, 7, 3), (4, 9, 5)])
def test_rolling_baselines(spark, tiny_blocks, stride, horizon, k):
    df, pdf = clean(spark, 80)
    want = naive_rows(pdf, 10, horizon, stride, k)
    got = pandas_of(baselines.rolling_seasonal(df, HOUR, 10, horizon, stride=stride, period=k), "series_id", "origin_ts", "h")
    assert len(got) == len(want)
    assert np.allclose(got["yhat"], [w[3] for w in want]) and np.allclose(got["actual"], [w[4] for w in want])
    o = origins.rolling_origins(df, HOUR, 10, horizon, stride=stride)
    joined = pandas_of(baselines.seasonal_naive(df, o, HOUR, horizon, k), "series_id", "origin_ts", "h")
    assert np.allclose(joined["yhat"], got["yhat"])
    mean = pandas_of(baselines.expanding_mean(df, HOUR, 10, horizon, stride=stride), "series_id", "origin_ts", "h")
    assert np.allclose(mean["yhat"], [w[5] for w in want])
    moving = pandas_of(baselines.moving_average(df, HOUR, 10, horizon, stride=stride), "series_id", "origin_ts", "h")
    expect = []
    for w in want:
        if w[2] == 1:
            buf = list(w[6])
        m = np.mean(buf)
        buf = buf[1:] + [m]
        expect.append(m)
    assert np.allclose(moving["yhat"], expect)


@pytest.mark.parametrize("p,d,marked", [(1, 0, True), (2, 1, True), (3, 2, True), (1, 0, False), (2, 1, False)])
def test_autoregression(spark, tiny_blocks, p, d, marked):
    """Fitted on the rows that ``train`` marks (here all), by default on those before the first origin."""
    df, pdf = clean(spark, 90)
    train = F.lit(True) if marked else None
    got = pandas_of(baselines.autoregression(df, HOUR, 5, p, d, lookback=10, train=train), "series_id", "origin_ts", "h")
    expect = []
    for _, part in pdf.groupby("series_id"):
        v = part["load"].to_numpy()
        z = [v]
        for _i in range(d):
            z.append(np.concatenate([[np.nan], np.diff(z[-1])]))
        y = z[d]
        first = max(10, int(0.2 * len(v)))
        rows = [i for i in range(len(y) if marked else first) if i - p >= d and not np.isnan(y[i])]
        x = np.array([[1, *[y[i - j] for j in range(1, p + 1)]] for i in rows])
        w = np.linalg.lstsq(x, y[rows], rcond=None)[0]
        for i in range(first, len(v) - 5 + 1, 5):
            hist, levels = [y[i - j] for j in range(1, p + 1)], [z[k][i - 1] for k in range(d)]
            for _h in range(5):
                nxt = w[0] + np.dot(w[1:], hist)
                hist = [nxt, *hist[:-1]]
                out = nxt
                for k in reversed(range(d)):
                    levels[k] += out
                    out = levels[k]
                expect.append(out)
    assert np.allclose(got["yhat"], expect)


@pytest.mark.parametrize("accuracy", [10, 100, 10000])
def test_exact_percentiles(spark, accuracy):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(0, 1, 501), "b": np.repeat([1.0, 2.0], 40), "c": np.array([7.0]), "d": np.exp(rng.normal(0, 6, 300))}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in blocks.exact_percentiles(df, ["k"], "v", probs, accuracy=accuracy).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        for name, p in probs.items():
            assert np.isclose(got[k][name], np.percentile(v, 100 * p))


def test_an_outlier_leaves_no_large_group(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("a").alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.sin("id")).alias("v"))
    got = blocks.exact_percentiles(df, ["k"], "v", {"p25": 0.25, "p50": 0.5, "p99": 0.99}).first()
    want = np.percentile(np.r_[1e12, np.sin(np.arange(1, n))], [25, 50, 99])
    assert np.allclose([got["p25"], got["p50"], got["p99"]], want, rtol=1e-9, atol=1e-12)
    assert blocks.around(df, ["k"], "v", [0.25, 0.5, 0.99], 10000).count() < 3 * 8 * n / 10000


def test_epoch_is_wall_clock(spark):
    df = spark.sql("SELECT timestamp_ntz'2021-03-14 02:30:00' AS ts")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = df.select(epoch("ts").alias("e")).first()["e"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == pd.Timestamp("2021-03-14 02:30").timestamp()


def test_duplicates_keep_a_whole_row_and_off_grid_readings_are_counted(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [("a", at(0), 5.0, 1.0), ("a", at(0), 3.0, 9.0), ("a", at(0), None, 0.0), ("a", at(0, 30), 7.0, 7.0), ("a", at(2), None, 4.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, load double, x double")
    got = [(r["load"], r["x"]) for r in grid.regular_grid(df, HOUR).orderBy("ts").collect()]
    assert got == [(3.0, 9.0), (None, None), (None, 4.0)]
    assert grid.off_grid(df, HOUR).first().asDict() == {"series_id": "a", "n_readings": 5, "n_off_grid": 1}

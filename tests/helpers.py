"""Small fixtures and conversions."""

from __future__ import annotations

import numpy as np
import pandas as pd

READINGS = "series_id string, ts timestamp_ntz, load double"


def frame(spark, pdf: pd.DataFrame, schema: str = READINGS):
    rows = [
        tuple(None if v is None or (isinstance(v, float) and np.isnan(v)) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r)
        for r in pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, schema)


def holed_series(n: int = 120, drop: float = 0.2, null: float = 0.15, seed: int = 1, names=("a", "b"), freq: str = "h"):
    """Hourly series with missing rows and missing values."""
    rng = np.random.default_rng(seed)
    out = []
    for k, name in enumerate(names):
        t = pd.date_range("2024-01-01 05:00", periods=n, freq=freq)
        v = 100 + 20 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 3, n) + 10 * k
        keep = rng.random(n) > drop
        keep[0] = keep[-1] = True
        v[rng.random(n) < null] = np.nan
        out.append(pd.DataFrame({"series_id": name, "ts": t, "load": v})[keep])
    return pd.concat(out, ignore_index=True)


def stride_series(n: int = 4000, seed: int = 3, name: str = "s"):
    """A learnable hourly series with a daily and a yearly cycle."""
    t = pd.date_range("2021-01-01", periods=n, freq="h")
    rng = np.random.default_rng(seed)
    v = 1000 + 200 * np.sin(2 * np.pi * (t.hour - 8) / 24) + 80 * np.cos(2 * np.pi * t.dayofyear / 365) + rng.normal(0, 12, n)
    return pd.DataFrame({"series_id": name, "ts": t, "load": v})


def pandas_of(df, *order):
    pdf = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    return pdf.sort_values(list(order or ("series_id", "ts"))).reset_index(drop=True)

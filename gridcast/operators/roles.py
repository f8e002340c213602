"""Which column plays which role."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.sources.readings import DataLoadError, nan_to_null, parse_timestamp

# Case-insensitive substrings of column names, by role.
DATETIME_PATTERNS = ("datetime", "timestamp", "date", "time", "dt")
TARGET_PATTERNS = (
    "kwh", "kw", "mwh", "mw", "load", "power", "energy", "electricity", "demand", "consumption", "usage",
)
TARGET_EXCLUDE_PATTERNS = ("forecast", "fcst", "pred", "solar", "pv", "generation")
COVARIATE_PATTERNS = (
    "temp", "temperature", "t_out", "tout", "rh", "humidity", "wet_bulb", "wetbulb", "enthalpy",
    "solar", "radiation", "irradiance", "ghi", "dni", "dhi", "global_horizontal", "direct_normal",
    "diffuse_horizontal", "wind", "cloud", "rain", "precip", "snow", "dew", "sunshine", "pressure",
    "hdd", "cdd", "degree_day", "degree_hour", "occup", "headcount", "people",
)
FUTURE_HINT_PATTERNS = (
    "holiday", "schedule", "is_open", "operating", "event", "special_day", "forecast", "fcst", "pred",
)
REDUNDANT_CALENDAR_PATTERNS = ("is_weekend", "weekend", "workday", "business_day")
CATEGORICAL_CODE_PATTERNS = ("code",)
TEMPERATURE_PATTERNS = ("temp", "t_out", "tout", "t2m")
# Fixed value: share of the values that must parse.
PARSE_SHARE = 0.9


@dataclass
class ColumnRoles:
    datetime: str | None = None
    target: str | None = None
    past: list[str] = field(default_factory=list)
    future: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    def rows(self, df: DataFrame) -> DataFrame:
        """The roles as rows ``(role, column_name)``."""
        pairs = [("datetime", self.datetime), ("target", self.target)]
        pairs += [("past_covariate", c) for c in self.past] + [("future_covariate", c) for c in self.future]
        pairs += [("target_excluded", c) for c in self.excluded]
        return df.sparkSession.createDataFrame([p for p in pairs if p[1]], "role string, column_name string")


def name_hits(name: str, patterns: Sequence[str]) -> bool:
    return any(p in name.lower() for p in patterns)


def parse_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of all non-null values of each text column that are times.

    One aggregate over all columns; only the shares reach the driver.
    """
    if not columns:
        return {}
    values = [F.col(f"`{c}`") for c in columns]
    shares = [F.avg(F.when(v.isNotNull(), parse_timestamp(v).isNotNull().cast("double"))).alias(f"s{i}") for i, v in enumerate(values)]
    return {c: share or 0.0 for c, share in zip(columns, df.agg(*shares).first(), strict=True)}


def detect_roles(
    df: DataFrame,
    datetime: Sequence[str] = DATETIME_PATTERNS,
    target: Sequence[str] = TARGET_PATTERNS,
    exclude: Sequence[str] = TARGET_EXCLUDE_PATTERNS,
    covariates: Sequence[str] = COVARIATE_PATTERNS,
) -> ColumnRoles:
    """Guess roles from names, types and a look at text values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c, t in types.items() if isinstance(t, T.NumericType)]
    text = [c for c, t in types.items() if isinstance(t, T.StringType)]
    clock = [c for c, t in types.items() if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    named = [c for c in text if name_hits(c, datetime)]
    shares = parse_shares(df, text)
    by_name_first = [*named, *(c for c in text if c not in named)]
    found = next((c for c in by_name_first if shares[c] >= PARSE_SHARE), None)
    found = found or next((c for c in [*clock, *numeric] if name_hits(c, datetime)), None)
    pool = [c for c in numeric if c != found]
    barred = [c for c in pool if name_hits(c, exclude)]
    allowed = [c for c in pool if c not in barred]
    chosen = next((c for c in allowed if name_hits(c, target)), None) or next(iter(allowed or pool), None)
    return ColumnRoles(
        datetime=found,
        target=chosen,
        past=[c for c in df.columns if c not in (found, chosen) and name_hits(c, covariates)],
        excluded=[c for c in barred if c != chosen],
    )


def role_hints(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Rows ``(column_name, hint)`` for what detection leaves open."""
    mapped = {roles.datetime, roles.target, *roles.past, *roles.future}
    open_columns = [c for c in df.columns if c not in mapped]
    hints = [(c, "unrecognised") for c in open_columns]
    hints += [(c, "future_covariate_candidate") for c in open_columns if name_hits(c, FUTURE_HINT_PATTERNS)]
    hints += [(c, "redundant_calendar") for c in open_columns if name_hits(c, REDUNDANT_CALENDAR_PATTERNS)]
    hints += [
        (c, "categorical_code")
        for c in df.columns
        if c != roles.datetime and name_hits(c, CATEGORICAL_CODE_PATTERNS)
    ]
    hints += [(c, "target_excluded") for c in roles.excluded]
    return df.sparkSession.createDataFrame(hints, "column_name string, hint string")


def validate_roles(df: DataFrame, roles: ColumnRoles) -> tuple[ColumnRoles, list[str]]:
    """Time and target must exist; absent covariates are dropped and named."""
    for role in ("datetime", "target"):
        name = getattr(roles, role)
        if name is None or name not in df.columns:
            raise DataLoadError(f"{role} column {name!r} not in {df.columns}")
    gone = [c for c in [*roles.past, *roles.future] if c not in df.columns]
    kept = ColumnRoles(
        roles.datetime, roles.target,
        [c for c in roles.past if c in df.columns], [c for c in roles.future if c in df.columns],
        roles.excluded,
    )
    return kept, gone


def temperature_column(columns: Sequence[str]) -> str | None:
    """The column named temperature, else the first one that looks like it."""
    exact = [c for c in columns if c.lower() == "temperature"]
    alike = [
        c for c in columns if not c.startswith(("cal_", "lag_")) and name_hits(c, TEMPERATURE_PATTERNS)
    ]
    return next(iter(exact + alike), None)


def to_readings(df: DataFrame, roles: ColumnRoles, series: str | None = None) -> DataFrame:
    """The long form: ``series_id, ts, load, covariates``."""
    parsed = df.schema[roles.datetime].dataType
    ts = parse_timestamp(roles.datetime) if isinstance(parsed, T.StringType) else F.col(roles.datetime)
    key = F.col(series).cast("string") if series else F.lit("series")
    return nan_to_null(df.select(
        key.alias("series_id"), ts.cast("timestamp_ntz").alias("ts"),
        F.col(roles.target).cast("double").alias("load"), *roles.past, *roles.future,
    ))

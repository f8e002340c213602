"""Clock arithmetic on ``TIMESTAMP_NTZ`` columns.

Everything is built from calendar fields and day-time intervals, so a result
never depends on the session time zone or on a DST rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported cadences and their seconds.
STEP_SECONDS = {"15min": 900, "30min": 1800, "h": 3600}
# Meteorological seasons.
SEASONS = ("winter", "spring", "summer", "fall")
# Names of the weekdays, Monday is 0.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

CALENDAR_COLUMNS = (
    "cal_hour", "cal_dow", "cal_month", "cal_is_weekend",
    "cal_hour_sin", "cal_hour_cos", "cal_dow_sin", "cal_dow_cos",
    "cal_month_sin", "cal_month_cos",
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch(ts: str | Column) -> Column:
    """Whole seconds since 1970-01-01 of the wall clock value."""
    c = col(ts)
    day = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def from_epoch(seconds: str | Column) -> Column:
    """Inverse of :func:`epoch`."""
    s = col(seconds).cast("long")
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    return origin + F.make_dt_interval(
        F.floor(s / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(s, F.lit(86400)).cast("decimal(18,6)")
    )


def add_seconds(ts: str | Column, seconds: Column | int) -> Column:
    """Shift a wall clock time by (possibly negative) seconds."""
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))


def season(ts: str | Column) -> Column:
    m = F.month(col(ts))
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "spring").when(m <= 8, "summer").otherwise("fall")
    )


def is_weekend(ts: str | Column) -> Column:
    return F.weekday(col(ts)) >= 5


def calendar(ts: str | Column) -> dict[str, Column]:
    """The ten calendar features of a timestamp."""
    hour, dow, month = F.hour(col(ts)), F.weekday(col(ts)), F.month(col(ts))
    out = {
        "cal_hour": hour,
        "cal_dow": dow,
        "cal_month": month,
        "cal_is_weekend": (dow >= 5).cast("int"),
    }
    for name, value, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month - 1, 12)):
        angle = value * F.lit(2.0 * math.pi / period)
        out[f"cal_{name}_sin"] = F.sin(angle)
        out[f"cal_{name}_cos"] = F.cos(angle)
    return out


def hours_to_steps(hours: int, step_seconds: int) -> int:
    """Number of grid steps in a number of hours (at least one)."""
    return max(1, hours * 3600 // step_seconds)


def steps_per_day(step_seconds: int) -> int:
    return max(1, 86400 // step_seconds)


def frequency_label(gap_seconds: str | Column) -> Column:
    """Name of the cadence within one minute of a gap, NULL when none is."""
    g = col(gap_seconds)
    out = F.lit(None).cast("string")
    for name, seconds in STEP_SECONDS.items():
        out = F.when(F.abs(g - seconds) <= 60, name).otherwise(out)
    return out


def supported(label: str | Column) -> Column:
    return F.coalesce(col(label).isin(*STEP_SECONDS), F.lit(False))

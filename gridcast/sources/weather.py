"""Weather payloads: JSON of parallel arrays to one row per time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Variable presets of the weather service.
PRESETS = {
    "minimal": ("temperature_2m", "relative_humidity_2m"),
    "building_load": (
        "temperature_2m", "relative_humidity_2m", "apparent_temperature",
        "shortwave_radiation", "wind_speed_10m", "cloud_cover", "precipitation",
    ),
    "extended": (
        "temperature_2m", "relative_humidity_2m", "dew_point_2m", "apparent_temperature",
        "shortwave_radiation", "direct_radiation", "diffuse_radiation", "wind_speed_10m",
        "wind_direction_10m", "cloud_cover", "precipitation", "surface_pressure", "is_day",
    ),
}
# Short column names.
SHORT_NAMES = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "relative_humidity",
    "apparent_temperature": "apparent_temperature",
    "dew_point_2m": "dew_point",
    "shortwave_radiation": "solar_radiation",
    "direct_radiation": "solar_direct",
    "diffuse_radiation": "solar_diffuse",
    "wind_speed_10m": "wind_speed",
    "wind_direction_10m": "wind_direction",
    "cloud_cover": "cloud_cover",
    "precipitation": "precipitation",
    "surface_pressure": "surface_pressure",
    "is_day": "is_day",
}
# Further variable names the service knows.
OTHER_VARIABLES = (
    "precipitation_probability", "rain", "showers", "snowfall", "snow_depth",
    "weather_code", "pressure_msl", "evapotranspiration", "et0_fao_evapotranspiration",
    "vapour_pressure_deficit", "cape", "visibility", "wind_gusts_10m",
    "soil_temperature_0cm", "soil_temperature_6cm", "uv_index", "sunshine_duration",
    "wet_bulb_temperature_2m", "freezing_level_height",
)


def unknown_variables(names: Sequence[str]) -> list[str]:
    """Names the service is not known to offer (reported, not refused)."""
    return [n for n in names if n not in SHORT_NAMES and n not in OTHER_VARIABLES]


def unpack_weather(
    payloads: DataFrame,
    column: str,
    variables: Sequence[str] | str = "building_load",
    keys: Sequence[str] = (),
    resolution: str = "hourly",
    rename: bool = True,
) -> DataFrame:
    """One row per time and key from JSON text.

    A variable absent from a payload gives NULLs; a variable absent from all of
    them is reported by :func:`absent_variables`. Times lose any offset.
    """
    names = PRESETS[variables] if isinstance(variables, str) else tuple(variables)
    fields = ", ".join(f"`{n}`: array<double>" for n in names)
    schema = f"struct<`{resolution}`: struct<time: array<string>, {fields}>>"
    body = payloads.select(*keys, F.from_json(column, schema).getField(resolution).alias("p"))
    # an absent variable is an empty array, which the zip pads with NULLs
    parts = [F.col("p.time").alias("time")]
    parts += [F.coalesce(F.col(f"p.{n}"), F.array().cast("array<double>")).alias(n) for n in names]
    rows = body.select(*keys, *parts).select(*keys, F.inline(F.arrays_zip("time", *names)))
    local = F.regexp_replace("time", r"(Z|[+-]\d{2}:?\d{2})$", "")
    out = rows.select(
        *keys, F.to_timestamp_ntz(F.replace(local, F.lit("T"), F.lit(" "))).alias("ts"),
        *[F.col(n).alias(SHORT_NAMES.get(n, n) if rename else n) for n in names],
    )
    return out


def absent_variables(
    payloads: DataFrame, column: str, variables: Sequence[str], resolution: str = "hourly"
) -> DataFrame:
    """Per requested variable: in how many payloads it is missing."""
    present = F.json_object_keys(F.get_json_object(column, f"$.{resolution}"))
    return (
        payloads.select(F.explode(F.array_except(F.array(*[F.lit(v) for v in variables]), present)).alias("variable"))
        .groupBy("variable")
        .agg(F.count(F.lit(1)).alias("n_payloads_missing"))
    )


def read_weather(spark: SparkSession, directory: str, **kwargs) -> DataFrame:
    """Unpack every JSON payload file in a directory."""
    text = spark.read.option("wholetext", True).text(directory)
    return unpack_weather(text, "value", **kwargs)

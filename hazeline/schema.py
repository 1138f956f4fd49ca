"""Column groups and schemas of the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The variables of the public weather and air quality archives, by layer.
WEATHER = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "precipitation", "rain", "surface_pressure", "et0_fao_evapotranspiration",
    "vapour_pressure_deficit", "wind_speed_10m", "wind_speed_100m", "wind_gusts_10m", "soil_temperature_0_to_7cm", "soil_temperature_7_to_28cm",
    "soil_moisture_0_to_7cm", "soil_moisture_7_to_28cm",
]
CODES = ["weather_code", "cloud_cover_low"]
AIR = ["pm10", "pm2_5", "aerosol_optical_depth", "dust", "nitrogen_dioxide"]
INFERRED = ["dewpoint_depression", "cooling_rate_6h", "cooling_rate_12h", "previous_night_low"]
KEYS = ["location", "time", "visibility_meters", "fog", "year"]
#: Visibilities above this stand for "missing"; other columns use MISSING.
VISIBILITY_LIMIT, MISSING = 999_000, -9999


def _layer(names: list[str], codes: tuple[str, ...] = ()) -> T.StructType:
    fields = [T.StructField("location", T.StringType()), T.StructField("time", T.TimestampNTZType())]
    return T.StructType(fields + [T.StructField(n, T.IntegerType() if n in codes else T.DoubleType()) for n in names])


WEATHER_LAYER = _layer([*WEATHER, *CODES], ("weather_code",))
APPENDED_LAYER = _layer([*WEATHER, *CODES, *INFERRED], ("weather_code",))
AIR_LAYER = _layer(AIR)
COMBINED_LAYER = _layer([*WEATHER, *INFERRED, *AIR, "visibility_meters"])
REPORT_LAYER = T.StructType([T.StructField("location", T.StringType()), T.StructField("DATE", T.TimestampNTZType()), T.StructField("VIS", T.StringType())])
METRICS = "location string, variant string, model string, split string, metric string, value double"
IMPORTANCE = "location string, variant string, model string, feature string, importance double, importance_pct double"


def feature_cols(df: DataFrame, keys: list[str] | None = None) -> list[str]:
    """Features by exclusion: every column that is no key."""
    out = {*(KEYS if keys is None else keys)}
    return [c for c in df.columns if c not in out]


def existing(df: DataFrame, wanted: list[str]) -> list[str]:
    """Features by intersection, in the order wanted."""
    return [c for c in wanted if c in df.columns]

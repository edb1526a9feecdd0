"""Raw energy and weather tables to the master table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from chronolith.functions.columns import (
    clip_upper, cooling_degrees, heating_degrees, kelvin_to_celsius, pattern_flag)
from chronolith.operators.align import join_master
from chronolith.operators.clean import WEATHER_PATTERNS, dedup_first, drop_null_target, utc_to_local
from chronolith.operators.grid import Grid, regularize
from chronolith.operators.stats import pivot_wide

# Names and physical limits of the source tables.
TARGET = "total load actual"
ZONE = "Europe/Madrid"
WIND_LIMIT, HUMIDITY_LIMIT = 25.0, 100.0
CONTINUOUS = ["HDD", "CDD", "wind_speed", "humidity", "cloud_cover_pct"]
FLAGS = list(WEATHER_PATTERNS)

WHOLE = Grid(by=(), ts="ts")


def energy_base(raw: DataFrame, zone: str = ZONE, utc: str = "ts_utc", time: str | None = "time") -> DataFrame:
    """Local wall clock, first of a repeated hour, full hourly spine; nothing is filled."""
    local = raw.withColumn("ts", utc_to_local(utc, zone))
    if time:
        local = local.drop(time)
    first = dedup_first(local, ["ts"], [utc]).drop(utc)
    return regularize(first, WHOLE)


def weather_measures(raw: DataFrame, zone: str = ZONE, utc: str = "ts_utc", order: Iterable = ()) -> DataFrame:
    """One row per hour and city with degree days, clipped measures and text flags."""
    local = raw.withColumn("ts", utc_to_local(utc, zone))
    rest = [c for c in ("temp", "humidity", "wind_speed", "clouds_all", "weather_description")]
    first = dedup_first(local.select("ts", "city_name", *rest, *[o for o in order if o not in rest], utc)
                        if order else local, ["ts", "city_name"], [*order] or [utc])
    celsius = kelvin_to_celsius(F.col("temp"))
    return first.select(
        "ts", "city_name",
        heating_degrees(celsius).alias("HDD"), cooling_degrees(celsius).alias("CDD"),
        clip_upper(F.col("wind_speed"), WIND_LIMIT).alias("wind_speed"),
        clip_upper(F.col("humidity"), HUMIDITY_LIMIT).alias("humidity"),
        (F.col("clouds_all") / 100.0).alias("cloud_cover_pct"),
        *[pattern_flag(F.col("weather_description"), p).alias(f) for f, p in WEATHER_PATTERNS.items()])


def weather_features(raw: DataFrame, cities: Iterable[str], zone: str = ZONE, utc: str = "ts_utc",
                     order: Iterable = ()) -> DataFrame:
    """One row per hour: city columns and national flags out of a single aggregate."""
    return pivot_wide(weather_measures(raw, zone, utc, order), ["ts"], "city_name", CONTINUOUS, cities,
                      extra={f: F.max(f) for f in FLAGS})


def master_table(energy: DataFrame, weather: DataFrame, target: str = TARGET) -> DataFrame:
    return drop_null_target(join_master(energy, weather, ["ts"]), target)

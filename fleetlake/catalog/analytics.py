"""Registered queries: table scan, staging, hourly mart, dashboard statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.catalog.registry import (
    DASHBOARD_VEHICLES,
    MART_CTE,
    RANGE_END,
    RANGE_START,
    REFRESH_FROM,
    STAGING_CTE,
    TELEMETRY_CTE,
    r,
    register,
    with_ctes,
)
from fleetlake.operators import marts, stats
from fleetlake.plans.build import read_mart, refresh_mart_days, write_mart
from fleetlake.session import scratch_path
from fleetlake.sources.tables import driver_telemetry

_IN_LIST = ", ".join(f"'{v}'" for v in DASHBOARD_VEHICLES)
_SCOPE = f"""vehicle_id IN ({_IN_LIST})
      AND "timestamp" >= TIMESTAMP '{RANGE_START}' AND "timestamp" <= TIMESTAMP '{RANGE_END}'"""


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.in_scope(driver_telemetry(spark, sf_dir), DASHBOARD_VEHICLES, RANGE_START, RANGE_END)


@register(
    "scan_telemetry",
    with_ctes(TELEMETRY_CTE) + "SELECT * FROM telemetry",
)
def scan_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source relation, every column."""
    return driver_telemetry(spark, sf_dir)


@register(
    "stg_vehicle_data",
    with_ctes(TELEMETRY_CTE, STAGING_CTE) + "SELECT * FROM stg_vehicle_data",
)
def stg_vehicle_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging projection."""
    return marts.stg_vehicle_data(driver_telemetry(spark, sf_dir))


@register(
    "fct_vehicle_hourly",
    with_ctes(TELEMETRY_CTE, STAGING_CTE, MART_CTE) + "SELECT * FROM fct_vehicle_hourly",
)
def fct_vehicle_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 (flagship): hourly rollup per vehicle."""
    return marts.fct_vehicle_hourly(marts.stg_vehicle_data(driver_telemetry(spark, sf_dir)))


@register(
    "stat_count",
    with_ctes(TELEMETRY_CTE) + f"SELECT count(*) AS value FROM telemetry WHERE {_SCOPE}",
)
def stat_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + F2 + F3: observations of three vehicles in a time range."""
    return stats.stat_count(_scope(spark, sf_dir))


@register(
    "stat_avg_soc",
    with_ctes(TELEMETRY_CTE) + f"SELECT {r('avg(soc)')} AS value FROM telemetry WHERE {_SCOPE}",
)
def stat_avg_soc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return stats.stat_avg(_scope(spark, sf_dir), "soc")


@register(
    "stat_avg_speed",
    with_ctes(TELEMETRY_CTE) + f"SELECT {r('avg(speed)')} AS value FROM telemetry WHERE {_SCOPE}",
)
def stat_avg_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return stats.stat_avg(_scope(spark, sf_dir), "speed")


@register(
    "dashboard_stats",
    with_ctes(TELEMETRY_CTE)
    + f"""SELECT count(*) AS observations, {r('avg(soc)')} AS avg_soc, {r('avg(speed)')} AS avg_speed
FROM telemetry WHERE {_SCOPE}""",
)
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3–A5 in one scan."""
    return stats.dashboard_stats(_scope(spark, sf_dir))


@register(
    "series_speed_soc",
    with_ctes(TELEMETRY_CTE)
    + f"""SELECT "timestamp" AS time, speed, soc FROM telemetry WHERE {_SCOPE} ORDER BY time""",
)
def series_speed_soc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 + O4: the time-series panel."""
    return stats.series_speed_soc(_scope(spark, sf_dir))


@register(
    "series_legend",
    with_ctes(TELEMETRY_CTE)
    + f"""SELECT field, {r('avg(value)')} AS mean, {r('arg_max(value, time_rank)')} AS last_not_null
FROM (
    SELECT field, value,
           row_number() OVER (PARTITION BY field ORDER BY time, value) AS time_rank
    FROM (
        SELECT "timestamp" AS time, 'speed' AS field, speed AS value FROM telemetry WHERE {_SCOPE}
        UNION ALL
        SELECT "timestamp" AS time, 'soc' AS field, soc AS value FROM telemetry WHERE {_SCOPE}
    ) s
    WHERE value IS NOT NULL
) t
GROUP BY field""",
)
def series_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legend mean and last non-NULL value of the speed and soc series."""
    return stats.series_legend(stats.series_speed_soc(_scope(spark, sf_dir), ordered=False))


@register(
    "distinct_vehicles",
    with_ctes(TELEMETRY_CTE) + "SELECT DISTINCT vehicle_id FROM telemetry ORDER BY vehicle_id",
)
def distinct_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return stats.distinct_vehicles(driver_telemetry(spark, sf_dir))


@register(
    "mart_refresh_days",
    with_ctes(TELEMETRY_CTE, STAGING_CTE, MART_CTE) + "SELECT * FROM fct_vehicle_hourly",
)
def mart_refresh_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 incremental: the mart built from the rows before a cut-off day, then
    every later day refreshed after the rest arrives, equals a full build."""
    telemetry = driver_telemetry(spark, sf_dir)
    cut = F.lit(REFRESH_FROM).cast("date")
    path = scratch_path(spark, "mart")
    early = telemetry.filter(F.to_date("timestamp") < cut)
    write_mart(marts.fct_vehicle_hourly(marts.stg_vehicle_data(early)), path, dynamic=False)
    later = telemetry.filter(F.to_date("timestamp") >= cut).select(F.to_date("timestamp").alias("day")).distinct()
    days = [row["day"] for row in later.collect()]  # the touched days: one row per day
    refresh_mart_days(spark, telemetry, path, days)
    return read_mart(spark, path)

"""Analytics models: the staging projection (P8) and the hourly mart (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.functions.timestamps import hour_bucket


def stg_vehicle_data(telemetry: DataFrame) -> DataFrame:
    """Analytics names; shift state trimmed (spaces), blank → NULL, upper."""
    return telemetry.select(
        F.col("id").alias("vehicle_data_id"),
        "vehicle_id",
        F.col("timestamp").alias("observed_at"),
        "speed",
        "odometer",
        F.col("soc").alias("state_of_charge_pct"),
        "elevation",
        F.upper(F.nullif(F.trim("shift_state"), F.lit(""))).alias("shift_state"),
    )


def fct_vehicle_hourly(staging: DataFrame) -> DataFrame:
    """A2: one row per vehicle and UTC hour.

    ``distance_travelled`` is max − min odometer *inside* the hour, exactly as
    the model defines it: travel between the last point of one hour and the
    first of the next is not counted, so hours do not add up to a trip.

    Plan: partial hash aggregate before the exchange, final after it; the key
    includes the hour, so one busy vehicle still spreads over many groups.
    """
    return staging.groupBy(
        "vehicle_id", hour_bucket("observed_at").alias("observed_hour")
    ).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.avg("speed").alias("average_speed"),
        F.min("state_of_charge_pct").alias("minimum_state_of_charge_pct"),
        F.max("state_of_charge_pct").alias("maximum_state_of_charge_pct"),
        (F.max("odometer") - F.min("odometer")).alias("distance_travelled"),
    )


def build_marts(telemetry: DataFrame, register_views: bool = True) -> dict[str, DataFrame]:
    """K4/K5 shape: staging is a view over the source, the mart a derived relation.

    Persisting the mart as a table is the caller's choice
    (``plans.build.write_mart`` / ``refresh_mart_days``); here both are lazily defined.
    """
    staging = stg_vehicle_data(telemetry)
    mart = fct_vehicle_hourly(staging)
    if register_views:
        staging.createOrReplaceTempView("stg_vehicle_data")
        mart.createOrReplaceTempView("fct_vehicle_hourly")
    return {"stg_vehicle_data": staging, "fct_vehicle_hourly": mart}

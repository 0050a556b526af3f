"""Registered queries: export files written and read back (K1–K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.catalog.registry import TELEMETRY_CTE, VEHICLE, register, with_ctes
from fleetlake.plans.export import export_downloads as export_joined, export_fleet, export_vehicle as export_one
from fleetlake.session import scratch_path
from fleetlake.sinks.files import read_joined, read_records
from fleetlake.sources.tables import driver_telemetry

_ISO_SQL = """CASE WHEN microsecond("timestamp") % 1000000 = 0
            THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '+00:00'
            ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END"""
_RECORDS_SQL = f"""SELECT vehicle_id, {_ISO_SQL} AS "timestamp", speed, odometer, soc, elevation, shift_state
FROM telemetry"""


def _roundtrip(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    out = scratch_path(spark, f"export-{fmt}")
    export_fleet(driver_telemetry(spark, sf_dir), out, fmt)
    return read_records(spark, out, fmt)


@register("export_json_roundtrip", with_ctes(TELEMETRY_CTE) + _RECORDS_SQL)
def export_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: fleet export as JSON Lines (NULLs kept), read back."""
    return _roundtrip(spark, sf_dir, "json")


@register("export_csv_roundtrip", with_ctes(TELEMETRY_CTE) + _RECORDS_SQL)
def export_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: fleet export as CSV with header (NULL → empty), read back."""
    return _roundtrip(spark, sf_dir, "csv")


@register(
    "export_vehicle",
    with_ctes(TELEMETRY_CTE) + _RECORDS_SQL + f" WHERE vehicle_id = '{VEHICLE}'",
)
def export_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + O3: one vehicle's export (CSV, the default), read back."""
    out = scratch_path(spark, "export-vehicle")
    export_one(spark, driver_telemetry(spark, sf_dir), VEHICLE, out, "csv")
    return read_records(spark, out, "csv")


@register(
    "export_manifest",
    with_ctes(TELEMETRY_CTE)
    + """SELECT vehicle_id, regexp_replace(vehicle_id, '[^a-zA-Z0-9_.-]', '_', 'g') || '_vehicle_data.json' AS file_name,
       'json' AS format, count(*) AS rows
FROM telemetry GROUP BY vehicle_id""",
)
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 at scale: the manifest of a fleet export (vehicle, file name, rows)."""
    out = scratch_path(spark, "export-manifest")
    return export_fleet(driver_telemetry(spark, sf_dir), out, "json")


@register(
    "export_downloads",
    with_ctes(TELEMETRY_CTE)
    + f"""SELECT *, 1 AS headers, TRUE AS in_order, TRUE AS complete FROM ({_RECORDS_SQL})""",
)
def export_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: one downloadable CSV per vehicle, read back: every record, and of its vehicle's file the header lines, whether
    its parts follow each other in time with the header first, and whether the listed parts add up to it."""
    out = scratch_path(spark, "export-downloads")
    parts = export_joined(driver_telemetry(spark, sf_dir), out, "csv", file_rows=5_000)
    rows = read_joined(spark, out, "csv")
    at = F.when(~F.col("is_header"), F.col("timestamp"))
    by_part = rows.groupBy("vehicle_id", "part").agg(
        F.count_if("is_header").alias("headers"), F.min(at).alias("from"), F.max(at).alias("to"))
    along = Window.partitionBy("vehicle_id").orderBy("part")
    placed = by_part.withColumn("n", F.row_number().over(along)).withColumn("before", F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    follows = F.coalesce(F.col("before") <= F.col("from"), F.lit(True)) & ((F.col("headers") == 0) | (F.col("n") == 1))
    files = placed.groupBy("vehicle_id").agg(
        F.sum("headers").alias("headers"), F.bool_and(follows).alias("in_order"), F.count("*").alias("n_parts"))
    listed = parts.groupBy("vehicle_id").agg(
        F.count("*").alias("n_listed"), (F.max(F.col("offset") + F.col("length")) == F.sum("length")).alias("adds_up"))
    complete = (F.col("adds_up") & (F.col("n_listed") == F.col("n_parts"))).alias("complete")
    judged = files.join(listed, "vehicle_id").select("vehicle_id", "headers", "in_order", complete)
    return rows.filter(~F.col("is_header")).drop("is_header", "part").join(judged, "vehicle_id")

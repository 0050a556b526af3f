"""Vehicle exports (K3, O3): one vehicle or the whole fleet, with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.functions.naming import export_file_name
from fleetlake.operators.query import filter_vehicle
from fleetlake.schema import EXPORT_FORMATS
from fleetlake.sinks.files import FILE_ROWS, export_records, joined_parts, read_records, write_joined, write_records


class VehicleNotFound(LookupError):
    pass


def export_vehicle(
    spark: SparkSession,
    telemetry: DataFrame,
    vehicle_id: str,
    path: str,
    export_format: str = "csv",
) -> DataFrame:
    """K3: every row of one vehicle in timestamp order, as a directory of
    ordered part files at ``path``. Raises ``VehicleNotFound`` when the
    vehicle has no rows (checked with a one-row probe before writing).
    Returns the one-row manifest ``vehicle_id, file_name, format, rows``."""
    if export_format not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {EXPORT_FORMATS}")
    rows = filter_vehicle(telemetry, vehicle_id)
    if rows.isEmpty():
        raise VehicleNotFound(f"No data found for vehicle '{vehicle_id}'")
    write_records(export_records(rows), path, export_format, by_vehicle=False)
    return export_manifest(read_records(spark, path, export_format), export_format)


def export_fleet(telemetry: DataFrame, path: str, export_format: str = "csv") -> DataFrame:
    """K3 at scale: all vehicles in one job, ``vehicle=<id>/`` per vehicle
    (ids that sanitise to the same name stay apart). Returns the manifest."""
    write_records(export_records(telemetry), path, export_format, by_vehicle=True)
    return export_manifest(read_records(telemetry.sparkSession, path, export_format), export_format)


def export_downloads(telemetry: DataFrame, path: str, export_format: str = "csv", file_rows: int = FILE_ROWS) -> DataFrame:
    """K3: the whole fleet, one downloadable file per vehicle. Returns ``vehicle_id, file_name, format, part, offset,
    length``: a vehicle's file is its parts from offset 0 on, end to end (one part, up to ``file_rows`` rows)."""
    write_joined(export_records(telemetry), path, export_format, file_rows)
    return joined_parts(telemetry.sparkSession, path).select(
        "vehicle_id", export_file_name("vehicle_id", export_format).alias("file_name"), F.lit(export_format).alias("format"),
        "part", "offset", "length")


def export_manifest(written: DataFrame, export_format: str) -> DataFrame:
    """``vehicle_id, file_name, format, rows`` — the download name per vehicle, and
    the rows that its files hold (``written`` is the export read back)."""
    return written.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("rows")).select(
        "vehicle_id",
        export_file_name("vehicle_id", export_format).alias("file_name"),
        F.lit(export_format).alias("format"),
        "rows",
    )

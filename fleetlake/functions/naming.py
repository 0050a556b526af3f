"""Names derived from paths and ids: vehicle id from a file path, safe export names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlake.functions.tokens import strip

SAFE_NAME_PATTERN = r"[^a-zA-Z0-9_.-]"
SAFE_NAME_FALLBACK = "vehicle"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    """Last path segment, URI-decoded (``car%201.csv`` → ``car 1.csv``; ``+`` stays ``+``)."""
    raw = F.regexp_extract(_col(path), r"([^/]+)$", 1)
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def file_stem(path: Column | str) -> Column:
    """File name without its last extension (``vehicle.data.csv`` → ``vehicle.data``).

    A leading dot alone is no extension (``.csv`` stays ``.csv``), as with pathlib.
    """
    name = file_name(path)
    pattern = r"^(.+)\.[^.]+$"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(name)


def vehicle_id_from_path(path: Column | str) -> Column:
    """Stripped stem of the file name; '' when nothing is left (rejected later)."""
    return strip(file_stem(path))


def has_csv_extension(path: Column | str) -> Column:
    return F.lower(file_name(path)).endswith(".csv")


def safe_file_name(vehicle_id: Column | str) -> Column:
    """P10: characters outside ``[a-zA-Z0-9_.-]`` → ``_``; empty → ``vehicle``."""
    cleaned = F.regexp_replace(_col(vehicle_id), SAFE_NAME_PATTERN, "_")
    return F.when(cleaned == F.lit(""), F.lit(SAFE_NAME_FALLBACK)).otherwise(cleaned)


def export_file_name(vehicle_id: Column | str, export_format: str) -> Column:
    """P10: ``<safe id>_vehicle_data.<ext>``."""
    return F.concat(safe_file_name(vehicle_id), F.lit(f"_vehicle_data.{export_format}"))

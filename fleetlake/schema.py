"""One StructType per relation, and the fixed column lists of the contract."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Fixed values of the ingest contract: the six CSV columns every file must
# carry (any order, extras allowed) and the case-blind null tokens.
REQUIRED_COLUMNS = ("timestamp", "speed", "odometer", "soc", "elevation", "shift_state")
NULL_TOKENS = ("", "NULL", "NONE", "N/A")

# Fixed values of the list query: sortable fields, orders, page size bounds.
SORT_FIELDS = ("id", "timestamp", "speed", "odometer", "soc", "elevation", "shift_state")
SORT_ORDERS = ("asc", "desc")
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500

# Fixed values of the export: column order and formats.
EXPORT_COLUMNS = ("vehicle_id", "timestamp", "speed", "odometer", "soc", "elevation", "shift_state")
EXPORT_FORMATS = ("csv", "json")

VEHICLE_ID_MAX_LENGTH = 100

# Logical telemetry row (the reference's ``vehicle_data``).
TELEMETRY = StructType(
    [
        StructField("id", LongType(), False),
        StructField("vehicle_id", StringType(), False),
        StructField("timestamp", TimestampType(), False),
        StructField("speed", DoubleType(), True),
        StructField("odometer", DoubleType(), False),
        StructField("soc", DoubleType(), False),
        StructField("elevation", DoubleType(), False),
        StructField("shift_state", StringType(), True),
    ]
)

# Physical layout of the stored table: the logical row plus two partition
# columns. ``observed_date`` prunes time-range reads, ``ingest_id`` makes one
# load (or one micro-batch) overwritable on replay.
PARTITION_COLUMNS = ("observed_date", "ingest_id")
STORED_TELEMETRY = StructType(
    TELEMETRY.fields
    + [
        StructField("observed_date", DateType(), True),
        StructField("ingest_id", StringType(), True),
    ]
)

# Parsed-but-not-yet-validated record, every contract column still text.
RAW_RECORD = StructType(
    [
        StructField("source_file", StringType(), True),
        StructField("row_number", LongType(), True),
        StructField("vehicle_id", StringType(), True),
    ]
    + [StructField(name, StringType(), True) for name in REQUIRED_COLUMNS]
)

REJECTS = StructType(
    [
        StructField("ingest_id", StringType(), True),
        StructField("source_file", StringType(), True),
        StructField("row_number", LongType(), True),
        StructField("vehicle_id", StringType(), True),
    ]
    + [StructField(f"raw_{name}", StringType(), True) for name in REQUIRED_COLUMNS]
    + [StructField("reject_reasons", ArrayType(StringType()), True)]
)

STAGING = StructType(
    [
        StructField("vehicle_data_id", LongType(), False),
        StructField("vehicle_id", StringType(), False),
        StructField("observed_at", TimestampType(), False),
        StructField("speed", DoubleType(), True),
        StructField("odometer", DoubleType(), False),
        StructField("state_of_charge_pct", DoubleType(), False),
        StructField("elevation", DoubleType(), False),
        StructField("shift_state", StringType(), True),
    ]
)

HOURLY_MART = StructType(
    [
        StructField("vehicle_id", StringType(), False),
        StructField("observed_hour", TimestampType(), True),
        StructField("observation_count", LongType(), False),
        StructField("average_speed", DoubleType(), True),
        StructField("minimum_state_of_charge_pct", DoubleType(), True),
        StructField("maximum_state_of_charge_pct", DoubleType(), True),
        StructField("distance_travelled", DoubleType(), True),
    ]
)

INGEST_AUDIT = StructType(
    [
        StructField("ingest_id", StringType(), True),
        StructField("source_file", StringType(), True),
        StructField("rows_read", LongType(), True),
        StructField("rows_valid", LongType(), True),
        StructField("rows_rejected", LongType(), True),
        StructField("rows_inserted", LongType(), True),
        StructField("rows_skipped", LongType(), True),
    ]
)

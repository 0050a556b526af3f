"""Export files (K1, K2): JSON Lines and CSV with a fixed column order.

An export is a *directory* per vehicle, written by many tasks in timestamp
order (part files sort by name in row order), never one file written by one
task: a vehicle may hold a third of all rows. :func:`write_joined` writes parts
that are one valid file when they are put end to end in the order of their names
(one part already, for a vehicle of up to ``FILE_ROWS`` rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from fleetlake.functions.timestamps import iso_text
from fleetlake.schema import EXPORT_COLUMNS, EXPORT_FORMATS
from fleetlake.session import ensure_conf, literal_path, scratch_path

EXPORT_SCHEMA = StructType(
    [
        StructField("vehicle_id", StringType(), True),
        StructField("timestamp", StringType(), True),
        StructField("speed", DoubleType(), True),
        StructField("odometer", DoubleType(), True),
        StructField("soc", DoubleType(), True),
        StructField("elevation", DoubleType(), True),
        StructField("shift_state", StringType(), True),
    ]
)
PARTITION_COLUMN = "vehicle"
#: Rows of a vehicle that one task writes as one file (some 100 MB).
FILE_ROWS = 1_000_000

CSV_WRITE_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "",
    "escape": '"',
}


def export_records(df: DataFrame) -> DataFrame:
    """The seven export columns (no ``id``); timestamp as ISO text."""
    ensure_conf(df.sparkSession)  # the text is UTC (+00:00)
    return df.select(
        "vehicle_id",
        iso_text("timestamp").alias("timestamp"),
        "speed",
        "odometer",
        "soc",
        "elevation",
        "shift_state",
    )


def write_records(records: DataFrame, path: str, export_format: str, by_vehicle: bool = True) -> None:
    """K1/K2: write export records, one directory per vehicle when ``by_vehicle``.

    Rows are range-partitioned on ``(vehicle_id, timestamp)`` and sorted
    inside each task, so part files are in timestamp order and one busy
    vehicle is split over many tasks. The timestamp text sorts like the
    instant (fixed width, UTC)."""
    if export_format not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {EXPORT_FORMATS}")
    # No fixed partition count: the session's shuffle partitions, coalesced by AQE.
    ordered = records.repartitionByRange("vehicle_id", "timestamp").sortWithinPartitions("vehicle_id", "timestamp")
    if by_vehicle:
        ordered = ordered.withColumn(PARTITION_COLUMN, F.col("vehicle_id"))
    writer = ordered.write.mode("overwrite")
    if by_vehicle:
        writer = writer.partitionBy(PARTITION_COLUMN)
    if export_format == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.options(**CSV_WRITE_OPTIONS).csv(path)


def read_records(spark: SparkSession, path: str, export_format: str) -> DataFrame:
    """Read an export back with the export schema (for round-trip checks)."""
    if export_format == "json":
        df = spark.read.schema(EXPORT_SCHEMA).json(literal_path(path))
    else:
        df = spark.read.schema(EXPORT_SCHEMA).options(**CSV_WRITE_OPTIONS).csv(literal_path(path))
    return df.select(*EXPORT_COLUMNS)


def write_joined(records: DataFrame, path: str, export_format: str, file_rows: int = FILE_ROWS) -> None:
    """K3: one directory per vehicle whose parts, end to end, are one valid file: a CSV has its header in the first
    part only. A vehicle of ``file_rows`` rows or fewer is one part; larger ones are cut by time over many tasks.

    The header is a row like any other, ahead of its vehicle's first; lines are made by the same CSV and JSON
    functions that the other exports use, and written as text.
    """
    if export_format not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {EXPORT_FORMATS}")
    spark = records.sparkSession
    row = F.struct(*EXPORT_COLUMNS)
    if export_format == "json":
        line = F.to_json(row, {"ignoreNullFields": "false"})
    else:
        line = F.to_csv(row, {k: v for k, v in CSV_WRITE_OPTIONS.items() if k != "header"})
    of_vehicle = F.col("vehicle_id").alias(PARTITION_COLUMN)
    lines = records.select(of_vehicle, F.col("timestamp").alias("_at"), line.alias("value"))
    counted = scratch_path(spark, "export-sizes")
    records.groupBy(of_vehicle).agg(F.count(F.lit(1)).alias("rows")).write.parquet(counted)
    sizes = spark.read.schema(f"{PARTITION_COLUMN} string, rows long").parquet(counted)
    if export_format == "csv":
        header = F.lit(",".join(EXPORT_COLUMNS)).alias("value")
        lines = lines.unionByName(sizes.select(PARTITION_COLUMN, F.lit(None).cast("string").alias("_at"), header))
    large = sizes.filter(F.col("rows") > file_rows)
    n_tasks = large.agg(F.sum(F.ceil(F.col("rows") / file_rows))).first()[0]
    whole = lines.join(large, PARTITION_COLUMN, "left_anti").repartition(PARTITION_COLUMN)
    if n_tasks:  # ranges are drawn from a sample of the large vehicles alone
        cut = lines.join(large, PARTITION_COLUMN, "left_semi")
        whole = cut.repartitionByRange(int(n_tasks), PARTITION_COLUMN, F.col("_at").asc_nulls_first()).unionByName(whole)
    ordered = whole.sortWithinPartitions(PARTITION_COLUMN, F.col("_at").asc_nulls_first())
    ordered.select("value", PARTITION_COLUMN).write.mode("overwrite").partitionBy(PARTITION_COLUMN).text(path)


def joined_parts(spark: SparkSession, path: str) -> DataFrame:
    """``(vehicle_id, part, offset, length)``: the parts of each vehicle's file, and the byte at which each begins.
    Files are listed, not read."""
    schema = StructType([
        StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()),
        StructField("content", BinaryType()), StructField(PARTITION_COLUMN, StringType())])
    listing = spark.read.format("binaryFile")
    if PARTITION_COLUMN not in listing.load(literal_path(path)).columns:  # nothing was exported
        return spark.createDataFrame([], "vehicle_id string, part string, offset long, length long")
    files = listing.schema(schema).load(literal_path(path))
    before = Window.partitionBy(PARTITION_COLUMN).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        F.col(PARTITION_COLUMN).alias("vehicle_id"), F.col("path").alias("part"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length")


def read_joined(spark: SparkSession, path: str, export_format: str) -> DataFrame:
    """The records of :func:`write_joined`, with the ``part`` they stand in; header rows (``is_header``) among them."""
    schema = StructType([*EXPORT_SCHEMA.fields, StructField(PARTITION_COLUMN, StringType(), True)])
    reader = spark.read.schema(schema)
    if export_format == "json":
        df = reader.json(literal_path(path))
    else:
        df = reader.options(**{**CSV_WRITE_OPTIONS, "header": "false"}).csv(literal_path(path))
    is_header = F.lit(export_format == "csv") & (F.col("timestamp") == F.lit("timestamp"))  # no record has that text
    vehicle = F.col(PARTITION_COLUMN).alias("vehicle_id")
    return df.select(vehicle, *EXPORT_COLUMNS[1:], is_header.alias("is_header"), F.col("_metadata.file_path").alias("part"))

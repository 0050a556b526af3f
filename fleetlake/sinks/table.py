"""Idempotent writes on plain Parquet (K5–K7).

Layout of the telemetry table: ``observed_date=…/ingest_id=…/part-….parquet``,
sorted inside by ``(vehicle_id, timestamp)`` so row-group statistics skip
data for vehicle and time filters. A load writes only its own ``ingest_id``
partitions with dynamic partition overwrite, so running it again replaces
exactly what it wrote before. Assumes one writer at a time. Files of a load
appear one by one; :func:`read_finished` leaves out loads that are under way.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from fleetlake.schema import INGEST_AUDIT, REJECTS, STORED_TELEMETRY, TELEMETRY
from fleetlake.session import literal_path


def _read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(literal_path(path)).select(*schema.fieldNames())
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _read_or_empty(spark, path, STORED_TELEMETRY)


def history_for(spark: SparkSession, path: str, dates: list, exclude_ingest: str | None) -> DataFrame:
    """Stored keys the batch can collide with: only its own dates and never
    its own earlier attempt (so a replay re-inserts).

    Only the batch's ``observed_date=`` folders are listed (one glob path with
    ``basePath``), not the whole table: a table with years of partitions is
    not listed again for every batch."""
    empty = spark.createDataFrame([], STORED_TELEMETRY)
    if not dates:
        return empty
    days = ",".join(sorted({d.isoformat() if hasattr(d, "isoformat") else str(d) for d in dates}))
    glob = f"{literal_path(path.rstrip('/'))}/observed_date={{{days}}}"
    try:
        hist = (
            spark.read.schema(STORED_TELEMETRY)
            .option("basePath", path)
            .parquet(glob)
            .select(*STORED_TELEMETRY.fieldNames())
        )
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    if exclude_ingest is not None:
        hist = hist.filter(F.col("ingest_id") != F.lit(exclude_ingest))
    return hist


def write_telemetry(rows: DataFrame, path: str, ingest_id: str) -> None:
    """K6: overwrite this load's partitions only (dynamic overwrite)."""
    out = rows.select(
        *[F.col(f.name).cast(f.dataType) for f in TELEMETRY.fields],
        F.to_date("timestamp").alias("observed_date"),
        F.lit(ingest_id).alias("ingest_id"),
    ).sortWithinPartitions("observed_date", "ingest_id", "vehicle_id", "timestamp")
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("observed_date", "ingest_id")
        .parquet(path)
    )


def replace_folders(rows: DataFrame, path: str) -> None:
    """Overwrite the ``observed_date=…/ingest_id=…`` folders that ``rows`` (stored rows, with these columns) name.
    Rows are dealt by folder and vehicle, so that a big folder is written by many tasks."""
    out = rows.select(*STORED_TELEMETRY.fieldNames())
    (
        out.repartitionByRange("observed_date", "ingest_id", "vehicle_id", "timestamp")
        .sortWithinPartitions("observed_date", "ingest_id", "vehicle_id", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("observed_date", "ingest_id")
        .parquet(path)
    )


def drop_folder(spark: SparkSession, path: str, day: str, ingest_id: str) -> None:
    """Remove the folder of a load's day that has no rows left (an overwrite by no rows would keep it)."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(ingest_id)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/observed_date={day}/ingest_id={name}")
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def write_rejects(rejected: DataFrame, path: str, ingest_id: str) -> None:
    """K7: rejected rows with raw text, reasons, file and row, per load."""
    out = rejected.select(
        *[
            (F.lit(ingest_id) if f.name == "ingest_id" else F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in REJECTS.fields
        ]
    )
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_id")
        .parquet(path)
    )


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return _read_or_empty(spark, path, REJECTS)


AUDIT_SCHEMA = StructType(
    INGEST_AUDIT.fields + [StructField("min_id", LongType(), True), StructField("max_id", LongType(), True)]
)


AUDIT_ROWS_PER_FILE = 250_000


def write_audit(audit: DataFrame, path: str, n_rows: int | None = None) -> None:
    """Per-file counters and id range of one load: one row per input file.
    Written as ``ceil(n_rows / 250k)`` files, so a load of millions of files
    is not funnelled through a single task."""
    out = audit.select(*[F.col(f.name).cast(f.dataType) for f in AUDIT_SCHEMA.fields])
    parts = max(1, -(-(n_rows or 0) // AUDIT_ROWS_PER_FILE))
    (
        out.repartition(parts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_id")
        .parquet(path)
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return _read_or_empty(spark, path, AUDIT_SCHEMA)


# One row per load: the ids it may use are base + 1 … last. Kept beside the
# table and written before the load's rows, so a range is never given twice,
# whatever fails later, and a replay finds the range it had. ``finished`` is
# false from before a load's first row until all it writes is written, also
# while it is replayed; loads of tables older than the column count as finished.
ID_LOG = StructType(
    [
        StructField("ingest_id", StringType(), False), StructField("base", LongType(), False), StructField("last", LongType(), False),
        StructField("finished", BooleanType(), True),
    ]
)


def id_log_path(table_path: str) -> str:
    return f"{table_path.rstrip('/')}-ids"


def read_id_log(spark: SparkSession, table_path: str) -> DataFrame:
    return _read_or_empty(spark, id_log_path(table_path), ID_LOG)


def unfinished_loads(spark: SparkSession, table_path: str) -> list[str]:
    """Loads under way, or stopped half-way and not replayed yet: a few."""
    rows = read_id_log(spark, table_path).filter(~F.col("finished")).select("ingest_id").distinct()
    return sorted(r[0] for r in rows.collect())


def read_finished(spark: SparkSession, path: str) -> DataFrame:
    """The table without the rows of unfinished loads, as of now: a load is seen
    whole or not at all. Their folders are pruned, so nothing is joined."""
    hidden = unfinished_loads(spark, path)
    rows = read_table(spark, path)
    return rows.filter(~F.col("ingest_id").isin(hidden)) if hidden else rows


def write_id_range(
    spark: SparkSession, table_path: str, ingest_id: str, base: int, last: int, finished: bool | None = None
) -> None:
    (
        spark.createDataFrame([(ingest_id, base, last, finished)], ID_LOG).coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_id")
        .parquet(id_log_path(table_path))
    )

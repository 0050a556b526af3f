"""Table scans: the stored telemetry table (S6) and the driver's stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.schema import TELEMETRY
from fleetlake.session import ensure_conf
from fleetlake.sinks.table import read_finished, read_table

TELEMETRY_COLUMNS = tuple(f.name for f in TELEMETRY.fields)


def read_telemetry(
    spark: SparkSession, path: str, keep_partition_columns: bool = False, finished_only: bool = True
) -> DataFrame:
    """Scan the stored table (``observed_date=…/ingest_id=…`` parquet).

    The schema is passed explicitly, so an empty or not-yet-created table
    reads as zero rows instead of failing, and nothing is inferred. Pair
    ``timestamp`` filters with ``observed_date`` (``operators.query.
    filter_time_range(date_col=...)``) to prune partitions. Loads that are
    under way, or that stopped half-way, are left out unless
    ``finished_only`` is false.
    """
    ensure_conf(spark)
    df = read_finished(spark, path) if finished_only else read_table(spark, path)
    return df if keep_partition_columns else df.select(*TELEMETRY_COLUMNS)


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Map the driver's ``events`` table onto the telemetry row.

    The mapping is fixed so an independent SQL engine can compute the same
    relation: ten vehicles ``veh-0``..``veh-9`` keyed by ``user_id % 10``;
    ``error`` events carry no speed; odometer grows with ``event_id``; soc is
    ``value`` (so some rows break the 0..100 range on purpose); elevation is
    the number inside ``props``; shift state is the upper-cased first letter
    of ``event_type``.
    """
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("veh-"), (F.col("user_id") % F.lit(10)).cast("string")).alias("vehicle_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == F.lit("error"), F.lit(None).cast("double"))
        .otherwise(F.col("value"))
        .alias("speed"),
        (F.col("event_id").cast("double") / F.lit(10.0)).alias("odometer"),
        F.col("value").alias("soc"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("double").alias("elevation"),
        F.upper(F.substring("event_type", 1, 1)).alias("shift_state"),
    )


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_conf(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def driver_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry relation the registered queries run on."""
    return telemetry_from_events(driver_table(spark, sf_dir, "events"))

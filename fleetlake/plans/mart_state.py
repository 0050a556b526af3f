"""The hourly mart from mergeable states (A2/K5): a load adds its own part, and a replay replaces it.

``refresh_mart_days`` reads every row of a touched day again. Here each load keeps
one state row per (vehicle, UTC hour) of its own rows (counts, a sum, smallest and
largest values), in a table laid out like the telemetry:
``observed_date=…/ingest_id=…``. After a load, :func:`refresh_states` reads the
load's own folders and overwrites its states, whether it is new, replayed or has
lost rows to ``reconcile``; :func:`refresh_mart` merges the states of the days that
changed, of all loads, and overwrites these days of the mart. So the rows of other
loads are never read again, however many came before.

One load is one addend of an average, so sums differ from a rebuild by rounding
only. States of loads that are unfinished in the table's log are left out, as
readers leave out their rows. Both steps give the same files when they are run
again after a crash.

Shuffles: rows are first aggregated in their map tasks, by vehicle and hour, so a
busy vehicle sends one row an hour and task; the states then move once by folder.
On the driver is one row for each folder of the loads named.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from fleetlake.functions.timestamps import hour_bucket
from fleetlake.plans.build import MART_COLUMNS, drop_day, write_mart
from fleetlake.session import ensure_conf, literal_path
from fleetlake.sinks import table as sink

_HOUR = ("vehicle_id", "observed_hour")
_FOLDER = ("observed_date", "ingest_id")
HOURLY_STATE = StructType(
    [
        StructField("vehicle_id", StringType(), True),
        StructField("observed_hour", TimestampType(), True),
        StructField("observation_count", LongType(), True),
        StructField("speed_count", LongType(), True),
        StructField("speed_sum", DoubleType(), True),
        StructField("soc_min", DoubleType(), True),
        StructField("soc_max", DoubleType(), True),
        StructField("odometer_min", DoubleType(), True),
        StructField("odometer_max", DoubleType(), True),
        StructField("observed_date", DateType(), True),
        StructField("ingest_id", StringType(), True),
    ]
)


def hourly_states(stored: DataFrame) -> DataFrame:
    """``HOURLY_STATE`` of stored telemetry (with ``observed_date`` and ``ingest_id``): a row per vehicle, hour and load."""
    return stored.groupBy(
        "vehicle_id", hour_bucket("timestamp").alias("observed_hour"), *_FOLDER
    ).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count("speed").alias("speed_count"),
        F.sum("speed").alias("speed_sum"),
        F.min("soc").alias("soc_min"),
        F.max("soc").alias("soc_max"),
        F.min("odometer").alias("odometer_min"),
        F.max("odometer").alias("odometer_max"),
    ).select(*HOURLY_STATE.fieldNames())


def merge_states(states: DataFrame) -> DataFrame:
    """The mart (``HOURLY_MART``): states of one vehicle and hour are added up, of any loads and in any order."""
    return states.groupBy(*_HOUR).agg(
        F.sum("observation_count").alias("observation_count"),
        F.try_divide(F.sum("speed_sum"), F.sum("speed_count")).alias("average_speed"),
        F.min("soc_min").alias("minimum_state_of_charge_pct"),
        F.max("soc_max").alias("maximum_state_of_charge_pct"),
        (F.max("odometer_max") - F.min("odometer_min")).alias("distance_travelled"),
    ).select(*MART_COLUMNS)


def read_states(spark: SparkSession, state_path: str) -> DataFrame:
    try:
        return spark.read.schema(HOURLY_STATE).parquet(literal_path(state_path)).select(*HOURLY_STATE.fieldNames())
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], HOURLY_STATE)
        raise


def _folders(rows: DataFrame) -> set[tuple[str, str]]:
    return {(r[0], r[1]) for r in rows.select(F.col("observed_date").cast("string"), "ingest_id").distinct().collect()}


def refresh_states(spark: SparkSession, table_path: str, state_path: str, ingest_ids: Iterable[str]) -> tuple[str, ...]:
    """Bring the states of these loads to what the table holds of them now; returns the UTC days that may have changed.

    Only the loads' own folders are read. A load that is unfinished, or no longer
    in the table, loses its states; so does a day that it has no rows of any more."""
    ensure_conf(spark)
    loads = sorted(set(ingest_ids))
    if not loads:
        return ()
    of_loads = F.col("ingest_id").isin(loads)
    before = _folders(read_states(spark, state_path).filter(of_loads))
    rows = sink.read_finished(spark, table_path).filter(of_loads)
    now = _folders(rows)
    if now:
        (
            hourly_states(rows)
            .repartitionByRange("observed_date", "ingest_id", *_HOUR)
            .sortWithinPartitions("observed_date", "ingest_id", *_HOUR)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_FOLDER)
            .parquet(state_path)
        )
    for day, load in sorted(before - now):
        sink.drop_folder(spark, state_path, day, load)
    return tuple(sorted({day for day, _ in before | now}))


def refresh_mart(spark: SparkSession, table_path: str, state_path: str, mart_path: str, days: Iterable[str]) -> None:
    """Overwrite these UTC days of the mart by the merged states of all finished loads; a day without states goes."""
    ensure_conf(spark)
    days = sorted({str(d) for d in days})
    if not days:
        return
    states = read_states(spark, state_path).filter(F.col("observed_date").isin([F.lit(d).cast("date") for d in days]))
    hidden = sink.unfinished_loads(spark, table_path)
    if hidden:
        states = states.filter(~F.col("ingest_id").isin(hidden))
    left = {day for day, _ in _folders(states)}
    if left:
        write_mart(merge_states(states), mart_path, dynamic=True)
    for day in sorted(set(days) - left):
        drop_day(spark, mart_path, day)


def update_mart(spark: SparkSession, table_path: str, state_path: str, mart_path: str, ingest_ids: Iterable[str]) -> tuple[str, ...]:
    """After loads, replays or a reconcile: their states, then the days of the mart that these reach."""
    days = refresh_states(spark, table_path, state_path, ingest_ids)
    refresh_mart(spark, table_path, state_path, mart_path, days)
    return days

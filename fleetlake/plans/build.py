"""Build with tests (D5, K4, K5): source checks → staging view → its checks →
mart → its checks, in dependency order; a failing stage skips what depends
on it. The summary is one small DataFrame (one row per model or check).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from fleetlake.operators import marts
from fleetlake.operators.quality import Check, check_counts
from fleetlake.schema import HOURLY_MART
from fleetlake.session import ensure_conf, literal_path, scratch_path

# The declared tests of the source, staging and mart models.
SOURCE_CHECKS = [
    Check("vehicle_data", "not_null", ("id",)),
    Check("vehicle_data", "unique", ("id",)),
    Check("vehicle_data", "not_null", ("vehicle_id",)),
    Check("vehicle_data", "not_null", ("timestamp",)),
]
STAGING_CHECKS = [
    Check("stg_vehicle_data", "not_null", ("vehicle_data_id",)),
    Check("stg_vehicle_data", "unique", ("vehicle_data_id",)),
    Check("stg_vehicle_data", "not_null", ("vehicle_id",)),
    Check("stg_vehicle_data", "not_null", ("observed_at",)),
    Check("stg_vehicle_data", "not_null", ("state_of_charge_pct",)),
    Check("stg_vehicle_data", "accepted_range", ("state_of_charge_pct",), 0, 100),
]
MART_CHECKS = [
    Check("fct_vehicle_hourly", "not_null", ("vehicle_id",)),
    Check("fct_vehicle_hourly", "not_null", ("observed_hour",)),
    Check("fct_vehicle_hourly", "not_null", ("observation_count",)),
    Check("fct_vehicle_hourly", "unique_combination", ("vehicle_id", "observed_hour")),
]

SUMMARY = StructType(
    [
        StructField("step", IntegerType(), False),
        StructField("model", StringType(), False),
        StructField("check_name", StringType(), False),
        StructField("column_name", StringType(), True),
        StructField("failures", LongType(), True),
        StructField("status", StringType(), False),
    ]
)


def _run_checks(df: DataFrame, checks: list[Check]) -> list[int]:
    got = {r["check_index"]: int(r["failures"]) for r in check_counts(df, checks).collect()}
    return [got[i] for i in range(len(checks))]


def build_with_tests(
    spark: SparkSession,
    source: DataFrame,
    mart_path: str | None = None,
) -> DataFrame:
    """Run the build. ``mart_path`` materialises the mart as a table (full
    rebuild); without it the mart stays a lazily defined relation."""
    rows: list[tuple] = []
    step = 0
    failed = False

    def add_checks(df: DataFrame | None, checks: list[Check]) -> bool:
        nonlocal step
        counts = _run_checks(df, checks) if df is not None and not failed else [None] * len(checks)
        any_fail = False
        for check, n in zip(checks, counts):
            step += 1
            status = "skipped" if n is None else ("pass" if n == 0 else "fail")
            any_fail = any_fail or status == "fail"
            rows.append((step, check.model, check.kind, ",".join(check.columns), n, status))
        return any_fail

    def add_model(name: str, ok: bool) -> None:
        nonlocal step
        step += 1
        rows.append((step, name, "build", None, None, "success" if ok else "skipped"))

    failed = add_checks(source, SOURCE_CHECKS)
    staging = None
    if not failed:
        staging = marts.stg_vehicle_data(source)
        staging.createOrReplaceTempView("stg_vehicle_data")
    add_model("stg_vehicle_data", not failed)
    failed = add_checks(staging, STAGING_CHECKS) or failed
    mart = None
    if not failed:
        mart = marts.fct_vehicle_hourly(staging)
        if mart_path:
            write_mart(mart, mart_path, dynamic=False)
            mart = read_mart(spark, mart_path)
        mart.createOrReplaceTempView("fct_vehicle_hourly")
    add_model("fct_vehicle_hourly", not failed)
    add_checks(mart, MART_CHECKS)
    return spark.createDataFrame(rows, SUMMARY)


# Mart rows of a day's file, about; a day has as many files as its rows need.
MART_ROWS_PER_FILE = 2_000_000
MOST_WRITE_TASKS = 100_000
MART_COLUMNS = tuple(HOURLY_MART.fieldNames())


def write_mart(mart: DataFrame, path: str, dynamic: bool, rows_per_file: int = MART_ROWS_PER_FILE) -> None:
    """K5: the mart as a table partitioned by UTC day. ``dynamic=False`` is a
    full rebuild; ``dynamic=True`` replaces only the days present in ``mart``.

    The mart is written once to scratch and counted by day there, one row a
    day, so that no day is funnelled through a fixed number of tasks."""
    spark, scratch = mart.sparkSession, scratch_path(mart.sparkSession, "mart")
    dated = mart.select(*MART_COLUMNS, F.to_date("observed_hour").alias("observed_date"))
    dated.write.parquet(scratch)
    out = spark.read.schema(dated.schema).parquet(scratch)
    files = out.groupBy("observed_date").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("_files"))
    # A vehicle has a row an hour, so its rows of a day may go to one file, whichever vehicle it is.
    slot = F.pmod(F.xxhash64("vehicle_id"), F.col("_files"))
    sized = out.join(F.broadcast(files), "observed_date").withColumn("_slot", slot)
    total = int(files.agg(F.sum("_files")).first()[0] or 1)
    (
        sized.repartition(max(1, min(total, MOST_WRITE_TASKS)), "observed_date", "_slot")
        .sortWithinPartitions("observed_date", "_slot", "vehicle_id", "observed_hour")
        .drop("_files", "_slot")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        .partitionBy("observed_date")
        .parquet(path)
    )


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(literal_path(path)).select(*MART_COLUMNS)


def refresh_mart_days(spark: SparkSession, telemetry: DataFrame, mart_path: str, days: list[date | str]) -> None:
    """K5, incremental: recompute the mart for the given UTC days only (e.g.
    the days a load touched) and overwrite just those partitions. An hour
    never spans two days, so the result equals a full rebuild.

    Pass the stored table with its ``observed_date`` column to prune the
    read to those days; otherwise rows are filtered by their timestamp."""
    ensure_conf(spark)
    if not days:
        return
    wanted = [F.lit(str(d)).cast("date") for d in days]
    if "observed_date" in telemetry.columns:
        source = telemetry.filter(F.col("observed_date").isin(wanted))
    else:
        source = telemetry.filter(F.to_date("timestamp").isin(wanted))
    mart = marts.fct_vehicle_hourly(marts.stg_vehicle_data(source))
    write_mart(mart, mart_path, dynamic=True)
    # Days that have no rows any more: nothing was written over what they had.
    left = {r[0] for r in source.select(F.to_date("timestamp").cast("string")).distinct().collect()}
    for day in sorted({str(d) for d in days} - left):
        drop_day(spark, mart_path, day)


def drop_day(spark: SparkSession, mart_path: str, day: str) -> None:
    """Remove a day's folder of the mart (an overwrite by no rows would keep it)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{mart_path.rstrip('/')}/observed_date={day}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

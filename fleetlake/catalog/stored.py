"""Registered queries on the stored table: written from the driver's telemetry, then scanned with pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.catalog.registry import (
    LOOKUP_ID,
    MART_CTE,
    RANGE_END,
    RANGE_START,
    REFRESH_FROM,
    STAGING_CTE,
    TELEMETRY_CTE,
    VEHICLE,
    register,
    with_ctes,
)
from fleetlake.operators import query
from fleetlake.plans.build import read_mart
from fleetlake.plans.mart_state import update_mart
from fleetlake.plans.reconcile import reconcile
from fleetlake.session import scratch_path
from fleetlake.sinks import key_index
from fleetlake.sinks import table as sink
from fleetlake.sources.tables import TELEMETRY_COLUMNS, driver_telemetry, read_telemetry

_VEHICLE = f"vehicle_id = '{VEHICLE}'"
_RANGE = f""""timestamp" >= TIMESTAMP '{RANGE_START}' AND "timestamp" <= TIMESTAMP '{RANGE_END}'"""
AFTER_VALUE, AFTER_ID = 40.0, 1000
REQUEST = query.PageRequest(
    VEHICLE, start=RANGE_START, end=RANGE_END, page=2, page_size=50, sort_by="speed", sort_order="asc"
)

DEEP_REQUEST = query.PageRequest(VEHICLE, page=12, page_size=40, sort_by="speed", sort_order="desc")
DEEP_ROWS = 100


def stored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's telemetry written as two loads, and read back with its partition columns."""
    path = scratch_path(spark, "stored")
    rows = driver_telemetry(spark, sf_dir)
    sink.write_telemetry(rows.filter(F.col("id") % 2 == 0), path, "even")
    sink.write_telemetry(rows.filter(F.col("id") % 2 == 1), path, "odd")
    return read_telemetry(spark, path, keep_partition_columns=True)


@register("stored_scan", with_ctes(TELEMETRY_CTE) + "SELECT * FROM telemetry")
def stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the stored table."""
    return stored_telemetry(spark, sf_dir).select(*TELEMETRY_COLUMNS)


@register("stored_range", with_ctes(TELEMETRY_CTE) + f"SELECT * FROM telemetry WHERE {_VEHICLE} AND {_RANGE}")
def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one vehicle's range; only the folders of its days are read."""
    rows = query.filter_vehicle(stored_telemetry(spark, sf_dir), VEHICLE)
    return query.filter_time_range(rows, RANGE_START, RANGE_END, date_col="observed_date").select(*TELEMETRY_COLUMNS)


@register(
    "stored_page",
    with_ctes(TELEMETRY_CTE) + f"""SELECT * FROM telemetry WHERE {_VEHICLE} AND {_RANGE}
ORDER BY speed ASC NULLS LAST, id LIMIT 50 OFFSET 50""",
)
def stored_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the second page of the range, from the stored table."""
    return query.page_items(stored_telemetry(spark, sf_dir), REQUEST, date_col="observed_date").select(*TELEMETRY_COLUMNS)


@register(
    "stored_page_after",
    with_ctes(TELEMETRY_CTE) + f"""SELECT * FROM telemetry WHERE {_VEHICLE} AND {_RANGE}
AND (speed IS NULL OR speed > {AFTER_VALUE} OR (speed = {AFTER_VALUE} AND id > {AFTER_ID}))
ORDER BY speed ASC NULLS LAST, id LIMIT 50""",
)
def stored_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, keyset form: the rows behind a value and id."""
    rows = query.page_after(stored_telemetry(spark, sf_dir), REQUEST, AFTER_VALUE, AFTER_ID, date_col="observed_date")
    return rows.select(*TELEMETRY_COLUMNS)


@register("stored_lookup", with_ctes(TELEMETRY_CTE) + f"SELECT * FROM telemetry WHERE id = {LOOKUP_ID}")
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by id from the stored table."""
    return query.point_lookup(stored_telemetry(spark, sf_dir), LOOKUP_ID).select(*TELEMETRY_COLUMNS)


@register(
    "insert_new_indexed",
    with_ctes(TELEMETRY_CTE) + """SELECT * FROM telemetry t WHERE id % 5 <> 0
AND NOT EXISTS (SELECT 1 FROM telemetry e WHERE e.id % 3 < 2 AND e.vehicle_id = t.vehicle_id AND e."timestamp" = t."timestamp")""",
)
def insert_new_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch against all stored keys: one load in the bucketed index, one that it lacks yet."""
    path = scratch_path(spark, "indexed")
    index = key_index.KeyIndex(
        f"fleetlake_keys_{uuid.uuid4().hex[:12]}", f"{path}-keys", max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = driver_telemetry(spark, sf_dir)
    for k, load in enumerate(("first", "second")):
        sink.write_id_range(spark, path, load, 0, 1)
        sink.write_telemetry(rows.filter(F.col("id") % 3 == k), path, load)
        if not k:
            key_index.refresh_key_index(spark, path, index)
    batch = rows.filter(F.col("id") % 5 != 0).select(*TELEMETRY_COLUMNS)
    return key_index.insert_new_indexed(spark, batch, path, index).select(*TELEMETRY_COLUMNS)


@register(
    "finished_loads",
    with_ctes(TELEMETRY_CTE) + """SELECT 'before' AS phase, * FROM telemetry WHERE id % 2 = 0
UNION ALL SELECT 'after', * FROM telemetry""",
)
def finished_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: what a reader sees while one load has stopped half-way, and after its replay."""
    path, seen = scratch_path(spark, "finished"), scratch_path(spark, "finished-seen")
    rows = driver_telemetry(spark, sf_dir)
    for load, left in (("even", 0), ("odd", 1)):
        own = rows.filter(F.col("id") % 2 == left)
        sink.write_id_range(spark, path, load, 0, 1, finished=False)
        sink.write_telemetry(own if not left else own.filter(F.col("id") % 4 == 1), path, load)
        if not left:
            sink.write_id_range(spark, path, load, 0, 1, finished=True)
    read_telemetry(spark, path).write.parquet(seen)
    sink.write_telemetry(rows.filter(F.col("id") % 2 == 1), path, "odd")
    sink.write_id_range(spark, path, "odd", 0, 1, finished=True)
    views = {"before": spark.read.parquet(seen), "after": read_telemetry(spark, path)}
    before, after = (df.select(F.lit(phase).alias("phase"), *TELEMETRY_COLUMNS) for phase, df in views.items())
    return before.unionByName(after)


@register(
    "reconciled_loads",
    with_ctes(TELEMETRY_CTE) + """SELECT id + CASE WHEN ingest_id = 'stream' THEN (SELECT max(id) FROM telemetry) ELSE 0 END AS id,
    vehicle_id, "timestamp", speed, odometer, soc, elevation, shift_state, ingest_id
FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, "timestamp" ORDER BY id, ingest_id) AS n FROM (
    SELECT *, 'batch' AS ingest_id FROM telemetry WHERE id % 3 <> 0 UNION ALL SELECT *, 'stream' FROM telemetry WHERE id % 3 <> 1))
WHERE n = 1""",
)
def reconciled_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads that overlap in keys and in ids, as two writers at a time leave them, brought back to one row each."""
    path = scratch_path(spark, "two-writers")
    rows = driver_telemetry(spark, sf_dir)
    highest = rows.agg(F.max("id")).first()[0] or 0
    for load, absent in (("batch", 0), ("stream", 1)):
        sink.write_id_range(spark, path, load, 0, highest, finished=True)
        sink.write_telemetry(rows.filter(F.col("id") % 3 != absent), path, load)
    reconcile(spark, path)
    return read_telemetry(spark, path, keep_partition_columns=True).select(*TELEMETRY_COLUMNS, "ingest_id")


@register("mart_from_states", with_ctes(TELEMETRY_CTE, STAGING_CTE, MART_CTE) + "SELECT * FROM fct_vehicle_hourly")
def mart_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2/K5: three loads that share every hour, the last of them late, and one first written without its later days and
    then replayed; the mart merged from their states equals a build from all rows."""
    base = scratch_path(spark, "mart-states")
    table, states, mart = f"{base}/table", f"{base}/states", f"{base}/mart"
    rows = driver_telemetry(spark, sf_dir)
    loads = [rows.filter(F.col("id") % 3 == k) for k in range(3)]
    sink.write_telemetry(loads[0].filter(F.to_date("timestamp") < F.lit(REFRESH_FROM).cast("date")), table, "load-0")
    sink.write_telemetry(loads[1], table, "load-1")
    update_mart(spark, table, states, mart, ["load-0", "load-1"])
    for k in (0, 2):
        sink.write_telemetry(loads[k], table, f"load-{k}")
        update_mart(spark, table, states, mart, [f"load-{k}"])
    return read_mart(spark, mart)


@register(
    "stored_page_deep",
    with_ctes(TELEMETRY_CTE) + f"""SELECT * FROM telemetry WHERE {_VEHICLE}
ORDER BY speed DESC NULLS FIRST, id LIMIT {DEEP_REQUEST.page_size} OFFSET {DEEP_REQUEST.offset}""",
)
def stored_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: a page behind the first ``DEEP_ROWS`` rows of a vehicle; only the range of speeds that holds it is sorted."""
    return query.page_deep(stored_telemetry(spark, sf_dir), DEEP_REQUEST, most_rows=DEEP_ROWS).select(*TELEMETRY_COLUMNS)

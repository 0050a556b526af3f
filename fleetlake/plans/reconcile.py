"""Two writers on one table (I3/T4): a batch import beside a running stream.

Both look for stored keys before either has written, so an observation may end
up in both loads, and both may draw the same range of ids. :func:`reconcile`
brings the table back to one row a key and one row an id, and rewrites only the
``observed_date=…/ingest_id=…`` folders that change.

* The first row of a key stays: the smallest id, then the smallest ingest id.
* A load whose range of ids overlaps that of a load before it (by base, then
  ingest id) is numbered anew behind all others, by one shift, and its range in
  the log is replaced first, so that a replay finds the new one.

Keys are compared with one shuffle of ``(vehicle_id, timestamp, id, load, day)``;
a group holds one row a load, so no key is hot. Kept rows are staged in the
shared scratch folder before a folder is replaced. The loads that change are
marked unfinished meanwhile: readers leave them out, and after a crash they show
in ``unfinished_loads`` until they have been replayed, which adds only keys that
no other load holds. Unfinished loads of other writers are neither read nor changed: run it
again after they end. On the driver are one row for each folder that changes and
for each load that is numbered anew.

Audit rows stay as they were counted at load time; the result says how many rows
each load lost since.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.operators.dedup import KEY
from fleetlake.schema import STORED_TELEMETRY
from fleetlake.session import ensure_conf, scratch_path
from fleetlake.sinks import table as sink

_FOLDER = ("observed_date", "ingest_id")


@dataclass
class ReconcileResult:
    rows_removed: dict[str, int] = field(default_factory=dict)  # by load
    loads_renumbered: dict[str, int] = field(default_factory=dict)  # load: what was added to its ids
    days: tuple[str, ...] = ()  # UTC days that lost rows: refresh_mart_days(…, days)


def later_copies(rows: DataFrame) -> DataFrame:
    """``(vehicle_id, timestamp, id, ingest_id, observed_date)`` of every row whose key an earlier row holds."""
    first = Window.partitionBy(*KEY).orderBy("id", "ingest_id")
    held = rows.select(*KEY, "id", *_FOLDER).withColumn("_n", F.row_number().over(first))
    return held.filter(F.col("_n") > 1).drop("_n")


def id_shifts(log: DataFrame) -> DataFrame:
    """``(ingest_id, base, last, shift)``: the loads of an id log whose range overlaps one before it.

    The log has one small row a load, so its windows are one short task.
    """
    in_order = Window.orderBy("base", "ingest_id")
    used = log.filter(F.col("last") > F.col("base"))
    reached = used.withColumn("_upto", F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    highest = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reached = reached.withColumn("_highest", F.max("last").over(highest))
    late = reached.filter(F.col("base") < F.col("_upto"))
    before = F.coalesce(F.sum(F.col("last") - F.col("base")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return late.withColumn("shift", F.col("_highest") + before - F.col("base")).select("ingest_id", "base", "last", "shift")


def reconcile(spark: SparkSession, table_path: str, days: list[str] | None = None) -> ReconcileResult:
    """Bring the finished loads of a table to one row a key and one row an id.

    ``days`` limits the search for keys to these UTC days (those that the two
    loads touched, ``IngestResult.days``); ids are compared for all loads.
    """
    ensure_conf(spark)
    log = {r.ingest_id: r for r in id_shifts(sink.read_id_log(spark, table_path).filter("finished is null or finished")).collect()}
    rows = sink.read_finished(spark, table_path)
    searched = rows if days is None else rows.filter(F.col("observed_date").isin(list(days)))
    staged = scratch_path(spark, "reconcile")
    later_copies(searched).write.parquet(f"{staged}/later")
    later = spark.read.parquet(f"{staged}/later")
    lost = {(str(r.observed_date), r.ingest_id): int(r.n) for r in later.groupBy(*_FOLDER).agg(F.count("*").alias("n")).collect()}
    loads = sorted({load for _, load in lost} | set(log))
    result = ReconcileResult(
        {load: sum(n for (_, k), n in lost.items() if k == load) for load in sorted({k for _, k in lost})},
        {load: int(r.shift) for load, r in sorted(log.items())}, tuple(sorted({day for day, _ in lost})))
    if not loads:
        return result

    # Folders that lose rows, and all folders of a load that is numbered anew.
    changed = F.col("ingest_id").isin(sorted(log))
    for load in result.rows_removed:
        own = [day for day, k in lost if k == load]
        changed = changed | ((F.col("ingest_id") == load) & F.col("observed_date").isin(own))
    shift = F.lit(0).cast("long")
    for load, r in log.items():
        shift = F.when(F.col("ingest_id") == load, F.lit(int(r.shift))).otherwise(shift)
    kept = rows.filter(changed).join(later.select(*KEY, "id", "ingest_id"), [*KEY, "id", "ingest_id"], "left_anti")
    kept.withColumn("id", F.col("id") + shift).select(*STORED_TELEMETRY.fieldNames()).write.parquet(f"{staged}/kept")
    kept = spark.read.parquet(f"{staged}/kept")
    filled = {(str(r.observed_date), r.ingest_id) for r in kept.select(*_FOLDER).distinct().collect()}

    ranges = {r.ingest_id: r for r in sink.read_id_log(spark, table_path).filter(F.col("ingest_id").isin(loads)).collect()}
    for load in loads:
        if load in ranges:
            r, by = ranges[load], result.loads_renumbered.get(load, 0)
            sink.write_id_range(spark, table_path, load, r.base + by, r.last + by, finished=False)
    sink.replace_folders(kept, table_path)
    for day, load in sorted(set(lost) - filled):
        sink.drop_folder(spark, table_path, day, load)
    for load in loads:
        if load in ranges:
            r, by = ranges[load], result.loads_renumbered.get(load, 0)
            sink.write_id_range(spark, table_path, load, r.base + by, r.last + by, finished=True)
    return result

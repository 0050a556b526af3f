"""Two writers on one table end with one row a key and one row an id."""

import glob

import pytest
from pyspark.sql import functions as F

from filetree import write_files
from fleetlake.plans.ingest import load_directory
from fleetlake.plans.reconcile import id_shifts, reconcile
from fleetlake.sinks import table as sink
from fleetlake.sources.tables import read_telemetry

HEADER = "timestamp,speed,odometer,soc,elevation,shift_state"


def lines(days, minutes=range(10), speed=1):
    return HEADER + "\n" + "".join(f"2031-02-{d:02d}T00:{m:02d}:00Z,{speed},2,3,4,D\n" for d in days for m in minutes)


@pytest.fixture()
def two_loads(spark, tmp_dir, monkeypatch):
    """A table whose second load saw neither the rows nor the id range of the first, as when both run at a time."""
    first = write_files(f"{tmp_dir}/a", {"car-1.csv": lines([1, 2]), "car-2.csv": lines([1])})
    second = write_files(f"{tmp_dir}/b", {"car-1.csv": lines([2, 3], speed=9), "car-2.csv": lines([1], range(5, 15), 9)})
    table = f"{tmp_dir}/t"
    load_directory(spark, first, table, "a:1")
    with monkeypatch.context() as m:
        read = sink.read_id_log
        m.setattr(sink, "history_for", lambda spark, path, dates, exclude_ingest: sink.read_table(spark, f"{tmp_dir}/none"))
        m.setattr(sink, "read_id_log", lambda spark, path: read(spark, path).filter("ingest_id <> 'a:1'"))
        m.setattr(sink, "read_table", lambda spark, path: spark.createDataFrame([], sink.STORED_TELEMETRY))
        load_directory(spark, second, table, "b")
    return table, second


def test_one_row_a_key_and_one_row_an_id(spark, two_loads):
    table, second = two_loads
    before = read_telemetry(spark, table)
    assert before.count() == 60 and before.select("id").distinct().count() == 30
    untouched = glob.glob(f"{table}/observed_date=*/ingest_id=a*/*.parquet")
    got = reconcile(spark, table)
    after = read_telemetry(spark, table)
    assert sum(got.rows_removed.values()) == 15 and got.loads_renumbered == {"b": 30}
    assert after.count() == 45 == after.select("vehicle_id", "timestamp").distinct().count() == after.select("id").distinct().count()
    assert got.days == ("2031-02-01", "2031-02-02") and sink.unfinished_loads(spark, table) == []
    assert {r.ingest_id: (r.base, r.last) for r in sink.read_id_log(spark, table).collect()} == {"a:1": (0, 30), "b": (30, 60)}
    if set(got.rows_removed) == {"b"}:
        assert glob.glob(f"{table}/observed_date=*/ingest_id=a*/*.parquet") == untouched
    again = reconcile(spark, table)
    assert (again.rows_removed, again.loads_renumbered, again.days) == ({}, {}, ())
    replay = load_directory(spark, second, table, "b")  # adds nothing that another load holds
    assert read_telemetry(spark, table).count() == 45 and replay.rows_read == 30
    assert read_telemetry(spark, table).select("id").distinct().count() == 45


def test_a_folder_without_rows_is_removed_and_given_days_alone_are_searched(spark, tmp_dir):
    table = f"{tmp_dir}/t"
    rows = spark.range(1, 21).select(
        "id", F.lit("v").alias("vehicle_id"), F.timestamp_seconds(F.col("id") * 8640).alias("timestamp"),
        *[F.lit(1.0).alias(c) for c in ("speed", "odometer", "soc", "elevation")], F.lit("D").alias("shift_state"))
    for load, by in (("x y", 0), ("z=1", 100)):
        sink.write_telemetry(rows.withColumn("id", F.col("id") + by), table, load)
        sink.write_id_range(spark, table, load, by, by + 20, finished=True)
    n_folders = len(glob.glob(f"{table}/*/*"))
    one = reconcile(spark, table, days=["1970-01-02"])
    assert one.rows_removed == {"z=1": 10} and one.days == ("1970-01-02",) and one.loads_renumbered == {}
    assert len(glob.glob(f"{table}/*/*")) == n_folders - 1 and read_telemetry(spark, table).count() == 30
    assert reconcile(spark, table).rows_removed == {"z=1": 10}
    assert sorted(r.id for r in read_telemetry(spark, table).collect()) == list(range(1, 21))


def test_loads_under_way_and_empty_tables_are_left_alone(spark, two_loads, tmp_dir):
    table, _ = two_loads
    sink.write_id_range(spark, table, "b", 0, 30, finished=False)
    got = reconcile(spark, table)
    assert not got.rows_removed and not got.loads_renumbered and sink.unfinished_loads(spark, table) == ["b"]
    assert sink.read_table(spark, table).count() == 60
    assert reconcile(spark, f"{tmp_dir}/nothing").rows_removed == {}


def test_ranges_behind_all_others(spark):
    log = spark.createDataFrame(
        [("a", 0, 10, True), ("b", 10, 20, True), ("c", 5, 8, True), ("d", 10, 14, None), ("e", 20, 20, True)], sink.ID_LOG)
    shifts = {r.ingest_id: (r.base + r.shift, r.last + r.shift) for r in id_shifts(log).collect()}
    assert shifts == {"c": (20, 23), "d": (23, 27)}

"""A load is seen whole or not at all; a day of the mart has the files that its rows need."""

import glob

import pytest
from pyspark.sql import functions as F

from filetree import write_files
from fleetlake.plans.build import read_mart, write_mart
from fleetlake.plans.ingest import load_directory
from fleetlake.sinks import table as sink
from fleetlake.sources.tables import read_telemetry

HEADER = "timestamp,speed,odometer,soc,elevation,shift_state"


def lines(days):
    return HEADER + "\n" + "".join(f"2031-02-{d:02d}T00:{m:02d}:00Z,1,2,3,4,D\n" for d in days for m in range(10))


def test_a_load_that_stops_is_hidden_and_its_replay_is_seen_once(spark, tmp_dir, monkeypatch):
    first = write_files(f"{tmp_dir}/a", {"car-1.csv": lines([1, 2])})
    second = write_files(f"{tmp_dir}/b", {"car-1.csv": lines([2, 3, 4])})
    table, audit = f"{tmp_dir}/t", f"{tmp_dir}/audit"
    load_directory(spark, first, table, "a", audit_path=audit)
    assert read_telemetry(spark, table).count() == 20

    def broken(*args, **kwargs):
        raise OSError("the store is gone")

    with monkeypatch.context() as m:
        m.setattr(sink, "write_audit", broken)
        with pytest.raises(OSError):
            load_directory(spark, second, table, "b", audit_path=audit)
    assert sink.unfinished_loads(spark, table) == ["b"]
    assert read_telemetry(spark, table).count() == 20
    assert read_telemetry(spark, table, finished_only=False).count() == 40
    again = load_directory(spark, second, table, "b", audit_path=audit)
    assert (again.rows_inserted, again.rows_skipped) == (20, 10)
    assert sink.unfinished_loads(spark, table) == []
    rows = read_telemetry(spark, table)
    assert rows.count() == 40 and rows.select("id").distinct().count() == 40


def test_a_replay_is_hidden_while_it_is_written(spark, tmp_dir, monkeypatch):
    src = write_files(f"{tmp_dir}/a", {"car-1.csv": lines([1])})
    table = f"{tmp_dir}/t"
    load_directory(spark, src, table, "a")
    seen = []
    write = sink.write_telemetry
    monkeypatch.setattr(sink, "write_telemetry", lambda rows, path, load: (write(rows, path, load), seen.append(read_telemetry(spark, table).count())))
    load_directory(spark, src, table, "a")
    assert seen == [0] and read_telemetry(spark, table).count() == 10


def test_tables_without_the_mark_are_seen(spark, tmp_dir):
    rows = spark.range(5).select(
        "id", F.lit("v").alias("vehicle_id"), F.timestamp_seconds("id").alias("timestamp"), *[F.lit(1.0).alias(c) for c in ("speed", "odometer", "soc", "elevation")],
        F.lit("D").alias("shift_state"))
    path = f"{tmp_dir}/t"
    sink.write_telemetry(rows, path, "old")
    log = spark.createDataFrame([("old", 0, 5)], "ingest_id string, base long, last long")
    log.write.partitionBy("ingest_id").parquet(sink.id_log_path(path))
    assert read_telemetry(spark, path).count() == 5


def test_files_of_a_mart_day_follow_its_rows(spark, tmp_dir):
    mart = spark.range(900).select(
        F.concat(F.lit("v"), F.col("id")).alias("vehicle_id"),
        F.when(F.col("id") < 800, F.timestamp_seconds(F.lit(0))).otherwise(F.timestamp_seconds(F.lit(86400))).alias("observed_hour"),
        F.lit(1).cast("long").alias("observation_count"), *[F.col("id").cast("double").alias(c) for c in (
            "average_speed", "minimum_state_of_charge_pct", "maximum_state_of_charge_pct", "distance_travelled")])
    path = f"{tmp_dir}/mart"
    write_mart(mart, path, dynamic=False, rows_per_file=100)
    assert sorted(map(tuple, read_mart(spark, path).collect())) == sorted(map(tuple, mart.collect()))
    big, small = (len(glob.glob(f"{path}/observed_date={d}/part-*")) for d in ("1970-01-01", "1970-01-02"))
    assert small == 1 and 2 < big <= 8
    write_mart(mart.limit(0), f"{tmp_dir}/none", dynamic=False)

"""The mart merged from the states of loads equals a rebuild, whatever was replayed, late or taken away."""

import pytest
from pyspark.sql import functions as F

from filetree import write_files
from fleetlake.operators import marts
from fleetlake.plans.build import read_mart
from fleetlake.plans.ingest import load_directory
from fleetlake.plans.mart_state import hourly_states, merge_states, read_states, refresh_states, update_mart
from fleetlake.sinks import table as sink
from fleetlake.sources.tables import read_telemetry

HEADER = "timestamp,speed,odometer,soc,elevation,shift_state"


def lines(days, minutes, speed="3"):
    return HEADER + "\n" + "".join(f"2031-02-{d:02d}T0{m % 3}:{m:02d}:00Z,{speed},{m},{m + d},4,D\n" for d in days for m in minutes)


def mart_rows(df):
    return sorted((r.vehicle_id, r.observed_hour, r.observation_count, r.average_speed, r.minimum_state_of_charge_pct,
                   r.maximum_state_of_charge_pct, r.distance_travelled) for r in df.collect())


def rebuilt(spark, table):
    return mart_rows(marts.fct_vehicle_hourly(marts.stg_vehicle_data(read_telemetry(spark, table))))


@pytest.fixture()
def paths(tmp_dir):
    return f"{tmp_dir}/t", f"{tmp_dir}/states", f"{tmp_dir}/mart"


def test_loads_late_rows_and_replays(spark, tmp_dir, paths):
    table, states, mart = paths
    loads = {
        "a:1": {"car-1.csv": lines([1, 2], range(0, 20)), "car-2.csv": lines([1], range(5), "NULL")},
        "b": {"car-1.csv": lines([2, 3], range(20, 30), "7"), "car-2.csv": lines([1], range(5, 9), "NULL")},
        "late": {"car-1.csv": lines([1], range(30, 40), "11"), "car-3.csv": lines([1], range(2))},
    }
    days = {"a:1": ("2031-02-01", "2031-02-02"), "b": ("2031-02-01", "2031-02-02", "2031-02-03"), "late": ("2031-02-01",)}
    for name, files in loads.items():
        load_directory(spark, write_files(f"{tmp_dir}/{name[0]}", files), table, name)
        assert update_mart(spark, table, states, mart, [name]) == days[name]
        assert mart_rows(read_mart(spark, mart)) == rebuilt(spark, table)
    before = read_states(spark, states).count()
    load_directory(spark, f"{tmp_dir}/b", table, "b")
    update_mart(spark, table, states, mart, ["b"])
    assert read_states(spark, states).count() == before
    got = mart_rows(read_mart(spark, mart))
    assert got == rebuilt(spark, table) and {r[3] for r in got if r[0] == "car-2"} == {None}


def test_only_the_folders_of_the_load_are_read(spark, tmp_dir, paths):
    table, states, _ = paths
    rows = spark.range(1, 41).select(
        "id", F.lit("v").alias("vehicle_id"), F.timestamp_seconds(F.col("id") * 3000).alias("timestamp"),
        F.lit(1.0).alias("speed"), F.lit(1.0).alias("odometer"), F.lit(1.0).alias("soc"), F.lit(1.0).alias("elevation"),
        F.lit(None).cast("string").alias("shift_state"))
    sink.write_telemetry(rows.filter("id <= 30"), table, "a")
    sink.write_telemetry(rows.filter("id > 30"), table, "b")
    assert refresh_states(spark, table, states, ["b"]) == ("1970-01-02",)
    plan = hourly_states(sink.read_finished(spark, table).filter(F.col("ingest_id").isin(["b"])))._jdf.queryExecution().toString()
    assert "PartitionFilters: [(ingest_id" in plan or "PartitionFilters: [isnotnull(ingest_id" in plan
    assert {r.ingest_id for r in read_states(spark, states).select("ingest_id").collect()} == {"b"}


def test_lost_days_unfinished_loads_and_empty_tables(spark, tmp_dir, paths):
    table, states, mart = paths
    assert update_mart(spark, table, states, mart, []) == () == update_mart(spark, table, states, mart, ["a"])
    load_directory(spark, write_files(f"{tmp_dir}/a", {"car-1.csv": lines([1, 2], range(9))}), table, "a")
    load_directory(spark, write_files(f"{tmp_dir}/b", {"car-1.csv": lines([2, 3], range(9, 20))}), table, "b")
    assert update_mart(spark, table, states, mart, ["a", "b"]) == ("2031-02-01", "2031-02-02", "2031-02-03")
    sink.drop_folder(spark, table, "2031-02-03", "b")  # as reconcile does with a folder that has no rows left
    assert update_mart(spark, table, states, mart, ["b"]) == ("2031-02-02", "2031-02-03")
    assert mart_rows(read_mart(spark, mart)) == rebuilt(spark, table) and len(rebuilt(spark, table)) == 6
    sink.write_id_range(spark, table, "b", 18, 40, finished=False)
    update_mart(spark, table, states, mart, ["b"])
    assert mart_rows(read_mart(spark, mart)) == rebuilt(spark, table)
    assert {r.ingest_id for r in read_states(spark, states).collect()} == {"a"}


def test_states_merge_in_any_grouping(spark):
    rows = spark.range(200).select(
        "id", (F.col("id") % 3).cast("string").alias("vehicle_id"), F.timestamp_seconds(F.col("id") * 100).alias("timestamp"),
        F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("speed"), F.col("id").cast("double").alias("odometer"),
        F.col("id").cast("double").alias("soc"), F.lit(1.0).alias("elevation"), F.lit("D").alias("shift_state"),
        F.to_date(F.timestamp_seconds(F.col("id") * 100)).alias("observed_date"), (F.col("id") % 7).cast("string").alias("ingest_id"))
    whole = mart_rows(marts.fct_vehicle_hourly(marts.stg_vehicle_data(rows)))
    assert mart_rows(merge_states(hourly_states(rows))) == whole
    assert mart_rows(merge_states(hourly_states(rows.withColumn("ingest_id", F.lit("one"))))) == whole

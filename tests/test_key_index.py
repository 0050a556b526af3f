"""The bucketed key index: history is not moved, and answers never depend on how fresh the index is."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from filetree import write_files
from fleetlake.plans.ingest import ingest_parsed, load_directory
from fleetlake.sinks.key_index import KeyIndex, indexed_loads, insert_new_indexed, refresh_key_index
from fleetlake.sinks.table import read_table, write_id_range, write_telemetry
from fleetlake.sources.csv_files import read_csv_directory

HEADER = "timestamp,speed,odometer,soc,elevation,shift_state"


@pytest.fixture()
def index(tmp_dir):
    return KeyIndex(f"keys_{uuid.uuid4().hex[:10]}", f"{tmp_dir}/keys", 8)


def telemetry(spark, first, last, vehicle="hot"):
    return spark.range(first, last).select(
        F.col("id"), F.concat(F.lit(vehicle), F.col("id") % 1).alias("vehicle_id"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"), F.lit(1.0).alias("speed"),
        F.lit(2.0).alias("odometer"), F.lit(3.0).alias("soc"), F.lit(4.0).alias("elevation"), F.lit("D").alias("shift_state"))


def stored(spark, path, load, rows):
    write_id_range(spark, path, load, 0, 1)
    write_telemetry(rows, path, load)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_fresh_stale_and_empty_index_give_one_answer(spark, tmp_dir, index):
    path, batch = f"{tmp_dir}/t", telemetry(spark, 0, 40)
    assert ids(insert_new_indexed(spark, batch, path, index)) == list(range(40))  # neither table nor index
    stored(spark, path, "a", telemetry(spark, 0, 10))
    expected = list(range(10, 40))
    assert ids(insert_new_indexed(spark, batch, path, index)) == expected  # all pending
    assert refresh_key_index(spark, path, index) == 1
    assert ids(insert_new_indexed(spark, batch, path, index)) == expected  # all indexed
    stored(spark, path, "b", telemetry(spark, 20, 30))
    mixed = [*range(10, 20), *range(30, 40)]
    assert ids(insert_new_indexed(spark, batch, path, index)) == mixed  # one of either
    assert ids(insert_new_indexed(spark, batch, path, index, "b")) == expected  # a replay of b sees its own rows as new
    assert refresh_key_index(spark, path, index) == 1 and refresh_key_index(spark, path, index) == 0
    assert ids(insert_new_indexed(spark, batch, path, index)) == mixed
    assert ids(insert_new_indexed(spark, batch, path, index, "a")) == [*range(0, 20), *range(30, 40)]
    assert sorted(r[0] for r in indexed_loads(spark, index).collect()) == ["a", "b"]


def test_a_session_that_lost_the_name_registers_it_again(spark, tmp_dir, index):
    path = f"{tmp_dir}/t"
    stored(spark, path, "a", telemetry(spark, 0, 10))
    refresh_key_index(spark, path, index)
    spark.sql(f"DROP TABLE `{index.name}`")  # external: the files stay
    assert ids(insert_new_indexed(spark, telemetry(spark, 5, 15), path, index)) == list(range(10, 15))


def test_a_refresh_that_stopped_before_its_list_changes_nothing(spark, tmp_dir, index):
    path = f"{tmp_dir}/t"
    stored(spark, path, "a", telemetry(spark, 0, 10))
    refresh_key_index(spark, path, index)
    stored(spark, path, "b", telemetry(spark, 10, 20))
    keys = read_table(spark, path).where("ingest_id = 'b'").select("vehicle_id", "timestamp", "ingest_id")
    keys.write.mode("append").format("parquet").option("path", index.path).bucketBy(8, "vehicle_id", "timestamp").sortBy(
        "vehicle_id", "timestamp").saveAsTable(index.name)
    assert refresh_key_index(spark, path, index) == 1
    assert ids(insert_new_indexed(spark, telemetry(spark, 5, 25), path, index)) == list(range(20, 25))


def test_history_is_scanned_in_buckets_and_not_moved(spark, tmp_dir, index):
    path = f"{tmp_dir}/t"
    stored(spark, path, "a", telemetry(spark, 0, 2000))
    refresh_key_index(spark, path, index)
    from fleetlake.operators.dedup import insert_new
    from fleetlake.sinks.key_index import indexed_keys

    joined = insert_new(telemetry(spark, 1000, 3000), indexed_keys(spark, index, "none").hint("merge"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert "SortMergeJoin" in initial and "Bucketed: true" in initial and "SelectedBucketsCount: 8 out of 8" in initial
    assert len(re.findall(r"Exchange hashpartitioning\(vehicle_id", initial)) == 1  # the batch alone
    assert joined.count() == 1000
    # A vehicle with all the rows fills the buckets alike.
    sizes = [r["count"] for r in spark.table(index.name).groupBy(F.regexp_extract(F.input_file_name(), r"_(\d{5})", 1)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 2000 / 8


def test_load_through_the_index(spark, tmp_dir, index):
    src = write_files(f"{tmp_dir}/in", {"car-1.csv": HEADER + "\n" + "".join(f"2031-02-0{d}T00:{m:02d}:00Z,1,2,3,4,D\n" for d in (3, 4) for m in range(30))})
    more = write_files(f"{tmp_dir}/more", {"car-1.csv": HEADER + "\n" + "".join(f"2031-02-0{d}T00:{m:02d}:00Z,9,2,3,4,D\n" for d in (4, 5) for m in range(30))})
    path = f"{tmp_dir}/t"
    assert load_directory(spark, src, path, "a", key_index=index).rows_inserted == 60
    refresh_key_index(spark, path, index)
    for _ in range(2):  # the second time as a replay
        result = ingest_parsed(spark, read_csv_directory(spark, more), path, "b", key_index=index, broadcast_bytes=0)
        assert (result.rows_inserted, result.rows_skipped) == (30, 30)
        refresh_key_index(spark, path, index)
    assert read_table(spark, path).count() == 90 and read_table(spark, path).where("speed = 9").count() == 30

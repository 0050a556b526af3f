"""Dense ids, first-writer-wins and existence checks, also with a hot key."""

import datetime as dt

from pyspark.sql import functions as F

from fleetlake.operators import dedup
from fleetlake.operators.identity import assign_ids


def _rows(spark, n, hot_share=3):
    base = dt.datetime(2026, 7, 21)
    data = []
    for i in range(n):
        vid = "hot" if i % hot_share == 0 else f"car-{i % 17}"
        data.append((vid, base + dt.timedelta(seconds=i), float(i)))
    return spark.createDataFrame(data, "vehicle_id string, timestamp timestamp, speed double")


def test_ids_are_dense_and_ordered_with_a_hot_vehicle(spark):
    df = _rows(spark, 3000)
    with_ids, helper = assign_ids(df, base=100, num_partitions=7)
    got = with_ids.select("id", "vehicle_id", "timestamp").collect()
    helper.unpersist()
    assert sorted(r["id"] for r in got) == list(range(101, 3101))
    in_order = sorted(got, key=lambda r: (r["vehicle_id"], r["timestamp"]))
    assert [r["id"] for r in in_order] == list(range(101, 3101))


def test_first_copy_wins_for_a_key_repeated_many_times(spark):
    ts = dt.datetime(2026, 7, 21, 10)
    data = [("a", ts, float(i), f"f{i // 100:03d}", i % 100) for i in range(2000)] + [("b", ts, -1.0, "f000", 0)]
    df = spark.createDataFrame(data, "vehicle_id string, timestamp timestamp, speed double, source_file string, line int")
    winners = dedup.dedup_first(df, order=[F.col("source_file"), F.col("line")])
    got = {r["vehicle_id"]: r["speed"] for r in winners.collect()}
    assert got == {"a": 0.0, "b": -1.0}
    plan = winners._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_insert_and_skip_counts(spark):
    ts = dt.datetime(2026, 7, 21, 10)
    incoming = spark.createDataFrame([("a", ts), ("b", ts), ("c", ts)], "vehicle_id string, timestamp timestamp")
    existing = spark.createDataFrame([("b", ts), ("b", ts)], "vehicle_id string, timestamp timestamp")
    assert sorted(r[0] for r in dedup.insert_new(incoming, existing).collect()) == ["a", "c"]
    assert [r[0] for r in dedup.already_present(incoming, existing).collect()] == ["b"]
    counts = dedup.insert_counts(dedup.mark_existing(incoming, existing)).first()
    assert (counts["inserted"], counts["skipped"]) == (2, 1)
    empty = incoming.limit(0)
    counts = dedup.insert_counts(dedup.mark_existing(empty, existing)).first()
    assert (counts["inserted"], counts["skipped"]) == (0, 0)

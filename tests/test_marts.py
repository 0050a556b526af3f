"""Staging projection and hourly mart."""

import datetime as dt

from fleetlake.operators import marts
from fleetlake.plans.build import build_with_tests
from fleetlake.schema import TELEMETRY


def _t(h, m):
    return dt.datetime(2022, 7, 12, h, m)


def test_hourly_mart_semantics(spark):
    rows = [
        (1, "a", _t(16, 42), None, 100.0, 58.0, 1.0, " d "),
        (2, "a", _t(16, 59), None, 100.0, 58.0, 1.0, ""),
        (3, "a", _t(17, 1), 10.0, 101.5, 57.0, 1.0, "D"),
        (4, "a", _t(17, 30), 20.0, 103.0, 56.0, 1.0, None),
        (5, "b", _t(17, 5), 5.0, 7.0, 70.0, 1.0, "P"),
    ]
    df = spark.createDataFrame(rows, TELEMETRY)
    staging = marts.stg_vehicle_data(df)
    assert [r["shift_state"] for r in staging.orderBy("vehicle_data_id").collect()] == ["D", None, "D", None, "P"]
    mart = {(r["vehicle_id"], r["observed_hour"].hour): r for r in marts.fct_vehicle_hourly(staging).collect()}
    a16, a17 = mart[("a", 16)], mart[("a", 17)]
    assert (a16["observation_count"], a16["average_speed"], a16["distance_travelled"]) == (2, None, 0.0)
    assert (a17["observation_count"], a17["average_speed"], a17["distance_travelled"]) == (2, 15.0, 1.5)
    assert (a17["minimum_state_of_charge_pct"], a17["maximum_state_of_charge_pct"]) == (56.0, 57.0)
    # Travel between 16:59 and 17:01 (1.5 km) falls between hours and is not counted anywhere.
    assert sum(r["observation_count"] for r in mart.values()) == df.count()


def test_hours_are_utc_whatever_the_session_zone(spark):
    rows = [(1, "a", dt.datetime(2022, 7, 12, 16, 42, tzinfo=dt.timezone.utc), 1.0, 1.0, 50.0, 1.0, "D")]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        df = spark.createDataFrame(rows, TELEMETRY)
        mart = marts.build_marts(df, register_views=False)["fct_vehicle_hourly"]
        start = mart.selectExpr("unix_micros(observed_hour) AS m").first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert start == int(dt.datetime(2022, 7, 12, 16, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def test_build_stops_at_first_failing_stage(spark):
    good = [(i, "a", _t(16, i), 1.0, 1.0 + i, 50.0, 1.0, "D") for i in range(3)]
    summary = build_with_tests(spark, spark.createDataFrame(good, TELEMETRY))
    statuses = {(r["model"], r["check_name"], r["column_name"]): r["status"] for r in summary.collect()}
    assert set(statuses.values()) == {"pass", "success"}

    bad = good + [(9, "a", _t(17, 1), 1.0, 1.0, 150.0, 1.0, "D")]
    summary = build_with_tests(spark, spark.createDataFrame(bad, TELEMETRY)).orderBy("step").collect()
    by_key = {(r["model"], r["check_name"], r["column_name"]): r for r in summary}
    assert by_key[("stg_vehicle_data", "accepted_range", "state_of_charge_pct")]["failures"] == 1
    assert by_key[("fct_vehicle_hourly", "build", None)]["status"] == "skipped"
    assert by_key[("fct_vehicle_hourly", "not_null", "vehicle_id")]["status"] == "skipped"


def test_build_materialises_the_mart(spark, tmp_dir):
    good = [(i, "a", _t(16, i), 1.0, 1.0 + i, 50.0, 1.0, "D") for i in range(3)]
    build_with_tests(spark, spark.createDataFrame(good, TELEMETRY), mart_path=f"{tmp_dir}/mart").collect()
    assert spark.read.parquet(f"{tmp_dir}/mart").first()["observation_count"] == 3

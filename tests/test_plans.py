"""Plan shapes that matter at scale: pushdown, pruning, partial aggregation, top-k."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_reaches_the_scan_and_columns_are_pruned(spark):
    plan = _plan(entry.queries()["stat_count"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_mart_is_partial_then_final_aggregate(spark):
    plan = _plan(entry.queries()["fct_vehicle_hourly"](spark, SF))
    assert "partial_count(1)" in plan and "partial_avg(speed" in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_page_is_a_bounded_top_k(spark):
    plan = _plan(entry.queries()["page"](spark, SF))
    assert "TakeOrderedAndProject(limit=300, offset=200" in plan


def test_dashboard_stats_share_one_scan(spark):
    plan = _plan(entry.queries()["dashboard_stats"](spark, SF))
    assert plan.count("FileScan parquet") == 1


def test_stored_table_range_prunes_date_partitions(spark, tmp_dir):
    import datetime as dt

    from fleetlake.operators import query
    from fleetlake.schema import TELEMETRY
    from fleetlake.sinks.table import write_telemetry
    from fleetlake.sources.tables import read_telemetry

    rows = [
        (i, "car-1", dt.datetime(2026, 7, 1 + i % 20, 10, tzinfo=dt.timezone.utc), 1.0, 1.0 + i, 50.0, 1.0, "D")
        for i in range(40)
    ]
    write_telemetry(spark.createDataFrame(rows, TELEMETRY), f"{tmp_dir}/t", "load-1")
    table = read_telemetry(spark, f"{tmp_dir}/t", keep_partition_columns=True)
    req = query.PageRequest("car-1", start="2026-07-05T00:00:00Z", end="2026-07-06T23:59:59Z", page_size=500)
    items, meta = query.page(table, req, date_col="observed_date")
    plan = _plan(items)
    assert "PartitionFilters: [isnotnull(observed_date" in plan
    assert "EqualTo(vehicle_id,car-1)" in plan  # pushed to Parquet row-group statistics
    assert meta.first()["total"] == 4


def test_parse_and_join_run_in_generated_code(spark, tmp_dir):
    """The scan, CSV parse and split join are one whole-stage-codegen stage. The
    reasons projection is deliberately compiled on its own (array_compact):
    fused, its method is too large for the JIT and measured 1.6x slower."""
    import re

    from filetree import write_files
    from fleetlake.operators import validate as v
    from fleetlake.sources.csv_files import read_csv_directory

    header = "timestamp,speed,odometer,soc,elevation,shift_state"
    write_files(tmp_dir, {"car-1.csv": header + "\n2026-07-21T10:30:00Z,1,2,3,4,D\n2026-07-21T10:31:00Z,x,,3,4,DR\n"})
    checked = v.validate(read_csv_directory(spark, tmp_dir).records)
    assert len(checked.collect()) == 2
    final = checked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = [line for line in final.split("\n") if "BroadcastHashJoin" in line]
    assert joins and all(re.search(r"\*\(\d+\) BroadcastHashJoin", line) for line in joins), joins

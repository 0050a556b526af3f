"""Ingest: counts add up, loading twice inserts nothing, first writer wins, ids are dense."""

import pytest
from pyspark.sql import functions as F

from filetree import write_files
from fleetlake.operators import validate
from fleetlake.plans.ingest import apply_mode, import_file, load_directory
from fleetlake.sinks.table import read_audit, read_rejects, read_table
from fleetlake.sources.csv_files import read_csv_directory

HEADER = "timestamp,speed,odometer,soc,elevation,shift_state"


def _paths(base):
    return f"{base}/table", f"{base}/rejects", f"{base}/audit"


def test_load_twice_inserts_nothing_and_counts_add_up(spark, tmp_dir):
    src = write_files(tmp_dir + "/in", {
        "car-1.csv": HEADER + "\n2031-02-03T04:05:06Z,61.25,777.5,40.0,-3.5,R\n"
                              "2031-02-03T04:06:06+00:00,,778.0,39.5,0.5,NULL\n",
        "car-2.csv": HEADER + "\n2026-07-21 11:00:00.4,NULL,500,50,1,p\n",
    })
    table, rejects, audit = _paths(tmp_dir)
    first = load_directory(spark, src, table, "load-1", rejects_path=rejects, audit_path=audit)
    assert (first.rows_read, first.rows_inserted, first.rows_skipped, first.rows_rejected) == (3, 3, 0, 0)
    second = load_directory(spark, src, table, "load-2", rejects_path=rejects, audit_path=audit)
    assert (second.rows_read, second.rows_inserted, second.rows_skipped) == (3, 0, 3)
    rows = read_table(spark, table).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3]
    car1 = [r for r in rows if r["vehicle_id"] == "car-1"]
    assert car1[0]["speed"] == 61.25 and car1[0]["shift_state"] == "R"
    assert car1[1]["speed"] is None and car1[1]["shift_state"] is None
    car2 = [r for r in rows if r["vehicle_id"] == "car-2"][0]
    assert car2["shift_state"] == "P" and car2["speed"] is None


def test_replay_same_ingest_id_rewrites_same_rows(spark, tmp_dir):
    src = write_files(tmp_dir + "/in", {
        "car-1.csv": HEADER + "\n" + "\n".join(
            f"2026-07-2{d}T10:{m:02d}:00Z,{m},{100 + m},50,1,D" for d in range(1, 4) for m in range(30)
        ) + "\n",
    })
    table, rejects, audit = _paths(tmp_dir)
    load_directory(spark, src, table, "load-1", audit_path=audit)
    before = sorted(tuple(r) for r in read_table(spark, table).collect())
    again = load_directory(spark, src, table, "load-1", audit_path=audit)
    after = sorted(tuple(r) for r in read_table(spark, table).collect())
    assert again.rows_inserted == 90
    assert before == after
    assert [r["id"] for r in read_table(spark, table).orderBy("id").collect()] == list(range(1, 91))


def test_in_file_duplicate_first_row_wins(spark, tmp_dir):
    src = write_files(tmp_dir + "/in", {
        "car-1.csv": HEADER + "\n2026-07-21T10:30:00Z,1,10,50,1,D\n2026-07-21T10:30:00Z,2,20,50,1,D\n",
    })
    table, rejects, audit = _paths(tmp_dir)
    res = load_directory(spark, src, table, "load-1", audit_path=audit)
    assert (res.rows_inserted, res.rows_skipped) == (1, 1)
    assert read_table(spark, table).first()["speed"] == 1.0


def test_strict_mode_rejects_whole_file_and_reports_first_row(spark, tmp_dir):
    src = write_files(tmp_dir + "/in", {
        "car-1.csv": HEADER + "\n2031-05-06T07:08:09Z,3,20,9,-1,R\n2031-05-06T07:08:10Z,4,,8,-2,R\n",
        "car-2.csv": HEADER + "\n2031-05-06T07:08:09Z,5,30,7,-3,P\n",
    })
    table, rejects, audit = _paths(tmp_dir)
    res = load_directory(spark, src, table, "load-1", rejects_path=rejects, audit_path=audit)
    assert (res.rows_read, res.rows_inserted, res.rows_rejected, res.files_rejected) == (3, 1, 2, 1)
    rej = read_rejects(spark, rejects).orderBy("row_number").collect()
    assert [(r["row_number"], r["reject_reasons"]) for r in rej] == [(2, ["file_rejected"]), (3, ["odometer_empty"])]
    per_file = {r["source_file"].rsplit("/", 1)[-1]: r for r in read_audit(spark, audit).collect()}
    assert per_file["car-1.csv"]["rows_rejected"] == 2
    assert per_file["car-2.csv"]["rows_inserted"] == 1


def test_permissive_mode_counts_null_soc_as_rejected(spark, tmp_dir):
    src = write_files(tmp_dir + "/in", {
        "car-1.csv": HEADER + "\n"
        "2026-07-21T10:30:00Z,7,100,,2,D\n"      # empty soc
        "2026-07-21T10:31:00Z,7,100,NaN,2,D\n"   # NaN soc
        "2026-07-21T10:32:00Z,7,-1,50,2,D\n"       # negative odometer
        "2026-07-21T10:33:00Z,1d,1,50,2,D\n"        # 1d is not a number here
        "T10:30,7,1,50,2,D\n"                      # not a date
        "2026-07-21T10:35:00Z,7,1,50,2,DR\n"       # two-character shift
        "2026-07-21T10:36:00Z,inf,1,50,nan,d\n",     # valid: inf speed, NaN elevation
    })
    table, rejects, audit = _paths(tmp_dir)
    res = load_directory(spark, src, table, "load-1", mode="permissive", rejects_path=rejects)
    assert (res.rows_read, res.rows_inserted, res.rows_rejected) == (7, 1, 6)
    reasons = {r["row_number"]: r["reject_reasons"] for r in read_rejects(spark, rejects).collect()}
    assert reasons == {
        2: ["soc_empty"], 3: ["soc_out_of_range"], 4: ["odometer_negative"], 5: ["speed_not_numeric"],
        6: ["timestamp_invalid"], 7: ["shift_state_too_long"],
    }


def test_import_single_file_uses_given_vehicle_id(spark, tmp_dir):
    write_files(tmp_dir + "/in", {"upload.csv": HEADER + "\n2026-07-21T23:59:59Z,8,90,6,4,N\n"})
    table, rejects, audit = _paths(tmp_dir)
    res = import_file(spark, f"{tmp_dir}/in/upload.csv", "car-7", table, "up-1")
    assert res.rows_inserted == 1
    assert read_table(spark, table).select("vehicle_id").first()[0] == "car-7"
    assert read_table(spark, table).filter(F.col("observed_date") == "2026-07-21").count() == 1


def test_refresh_mart_days_after_a_load(spark, tmp_dir):
    from fleetlake.plans.build import read_mart, refresh_mart_days, write_mart
    from fleetlake.operators import marts
    from fleetlake.sources.tables import read_telemetry

    src = write_files(tmp_dir + "/in", {"car-1.csv": HEADER + "\n2026-07-21T10:30:00Z,10,100,50,1,D\n"})
    table, rejects, audit = _paths(tmp_dir)
    load_directory(spark, src, table, "load-1", audit_path=audit)
    stored = read_telemetry(spark, table, keep_partition_columns=True)
    write_mart(marts.fct_vehicle_hourly(marts.stg_vehicle_data(stored)), f"{tmp_dir}/mart", dynamic=False)
    more = write_files(tmp_dir + "/in2", {"car-1.csv": HEADER + "\n2026-07-21T10:45:00Z,30,103,49,1,D\n"
                                                      "2026-07-22T08:00:00Z,5,110,40,1,D\n"})
    res = load_directory(spark, more, table, "load-2", audit_path=audit)
    assert res.days == ("2026-07-21", "2026-07-22")
    refresh_mart_days(spark, read_telemetry(spark, table, keep_partition_columns=True), f"{tmp_dir}/mart", res.days)
    got = {r["observed_hour"].hour: r for r in read_mart(spark, f"{tmp_dir}/mart").collect()}
    assert got[10]["observation_count"] == 2 and got[10]["distance_travelled"] == 3.0
    assert got[8]["observation_count"] == 1


def test_files_per_batch_splits_a_backfill(spark, tmp_dir):
    files = {
        f"car {i}.csv": HEADER + "\n" + "\n".join(f"2026-07-2{d}T10:0{i}:00Z,1,{10 * i + d},50,1,D" for d in range(1, 4)) + "\n"
        for i in range(5)
    }
    src = write_files(tmp_dir + "/in", files)
    table, rejects, audit = _paths(tmp_dir)
    res = load_directory(spark, src, table, "big", audit_path=audit, files_per_batch=2)
    assert (res.rows_read, res.rows_inserted) == (15, 15)
    loads = sorted({r["ingest_id"] for r in read_audit(spark, audit).collect()})
    assert loads == ["big-0", "big-1", "big-2"]
    assert sorted(r["id"] for r in read_table(spark, table).collect()) == list(range(1, 16))
    again = load_directory(spark, src, table, "big", audit_path=audit, files_per_batch=2)
    assert again.rows_inserted == 15  # each group replays its own partitions
    assert sorted(r["id"] for r in read_table(spark, table).collect()) == list(range(1, 16))


def _car(times):
    return {"car-1.csv": HEADER + "\n" + "".join(f"2031-02-03T04:{m:02d}:00Z,1,{m},50,1,D\n" for m in times)}


def test_ids_stay_unique_and_the_same_with_and_without_audit(spark, tmp_dir):
    table, _, audit = _paths(tmp_dir)
    loads = [("l0", audit, range(3)), ("l1", None, range(3, 5)), ("l2", audit, range(5, 9))]
    for name, log, times in loads:
        load_directory(spark, write_files(f"{tmp_dir}/{name}", _car(times)), table, name, audit_path=log)
    before = {(r["timestamp"], r["id"]) for r in read_table(spark, table).collect()}
    assert sorted(i for _, i in before) == list(range(1, 10))
    for name in ("l0", "l1"):  # replays of loads that are not the last
        load_directory(spark, f"{tmp_dir}/{name}", table, name)
    assert {(r["timestamp"], r["id"]) for r in read_table(spark, table).collect()} == before


def test_an_id_range_is_taken_before_the_rows_are_written(spark, tmp_dir, monkeypatch):
    from fleetlake.sinks import table as sink

    table, _, audit = _paths(tmp_dir)

    def crash(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sink, "write_telemetry", crash)
        with pytest.raises(OSError):
            load_directory(spark, write_files(f"{tmp_dir}/a", _car(range(3))), table, "a", audit_path=audit)
    load_directory(spark, write_files(f"{tmp_dir}/b", _car(range(10, 12))), table, "b", audit_path=audit)
    load_directory(spark, f"{tmp_dir}/a", table, "a", audit_path=audit)
    ids = {r["timestamp"].minute: r["id"] for r in read_table(spark, table).collect()}
    assert ids == {0: 1, 1: 2, 2: 3, 10: 4, 11: 5}


def test_no_single_row_stops_a_load(spark, tmp_dir):
    cells = ["0000-01-01T00:00:00Z,1,1,1,1,D", "9999-12-31T23:30:00-05:00,1,1,1,1,D", "0001-01-01T00:30:00+02:00,1,1,1,1,D",
             f"2031-02-03T04:00:00Z,1,{'1_' * 20_000}x,1,1,D", f"2031-02-03T04:00:00Z,1,1,{'9' * 20_000},1,D",
             "9999-12-31T23:59:59Z,1,1,1,1,D", "0001-01-01T00:00:00Z,1,1,1,1,D"]
    src = write_files(tmp_dir + "/in", {"car-1.csv": (HEADER + "\n" + "\n".join(cells) + "\n").encode() + b"2031-02-03T04:00:00Z,1,1,1,1,\xff\n"})
    table, rejects, audit = _paths(tmp_dir)
    res = load_directory(spark, src, table, "l", mode="permissive", rejects_path=rejects, audit_path=audit)
    assert (res.rows_read, res.rows_inserted, res.rows_rejected) == (8, 2, 6)
    assert res.days == ("0001-01-01", "9999-12-31")
    assert {r["row_number"]: r["reject_reasons"] for r in read_rejects(spark, rejects).collect()} == {
        2: ["timestamp_invalid"], 3: ["timestamp_invalid"], 4: ["timestamp_invalid"], 5: ["odometer_not_numeric"],
        6: ["soc_out_of_range"], 9: ["encoding_invalid"]}


def test_glob_characters_in_the_table_path(spark, tmp_dir):
    table = f"{tmp_dir}/d[1]/t"
    src = write_files(f"{tmp_dir}/in[2]", _car(range(2)))
    assert load_directory(spark, src, table, "a").rows_inserted == 2
    assert load_directory(spark, src, table, "b").rows_inserted == 0
    assert read_table(spark, table).count() == 2


def test_bad_files_without_rows_count_as_rejected(spark, tmp_dir):
    src = write_files(tmp_dir + "/in", {"none.csv": "", "only.csv": "soc,speed\n", **_car(range(2))})
    table, _, audit = _paths(tmp_dir)
    res = load_directory(spark, src, table, "l", audit_path=audit)
    assert (res.rows_inserted, res.files_rejected) == (2, 2)
    assert sorted(r["source_file"].rsplit("/", 1)[-1] for r in read_audit(spark, audit).collect()) == ["car-1.csv", "none.csv", "only.csv"]


def test_refresh_removes_days_without_rows(spark, tmp_dir):
    from fleetlake.operators import marts
    from fleetlake.plans.build import read_mart, refresh_mart_days, write_mart
    from fleetlake.sources.tables import read_telemetry

    table, _, _ = _paths(tmp_dir)
    src = write_files(tmp_dir + "/in", {"car-1.csv": HEADER + "\n2031-02-03T04:00:00Z,1,1,1,1,D\n2031-02-04T04:00:00Z,1,1,1,1,D\n"})
    load_directory(spark, src, table, "a")
    rows = read_telemetry(spark, table, keep_partition_columns=True)
    write_mart(marts.fct_vehicle_hourly(marts.stg_vehicle_data(rows)), f"{tmp_dir}/mart", dynamic=False)
    gone = rows.filter("observed_date <> DATE'2031-02-03'")
    refresh_mart_days(spark, gone, f"{tmp_dir}/mart", ["2031-02-03", "2031-02-04"])
    assert [r["observed_hour"].day for r in read_mart(spark, f"{tmp_dir}/mart").collect()] == [4]


def test_whole_file_rule_validates_once_and_keeps_its_rows(spark, tmp_dir):
    """Both joins; values at the ends of the calendar pass through the held rows."""
    head = HEADER + "\n"
    good = ["0001-01-02T00:00:00.000001Z", "1500-03-01T00:00:00Z", "1899-12-31T23:59:59.999999Z", "9999-12-31T23:59:59Z"]
    files = {"ok.csv": head + "".join(f"{t},NULL,1e3,50,-0.0,d\n" for t in good), "empty.csv": head}
    files["bad.csv"] = head + f"{good[1]},1,2,3,4,D\n" + "x,1,2,3,4,D\n" + f"{good[0]},1,2,3,4,D\n"
    write_files(tmp_dir, files)
    checked = validate.validate(read_csv_directory(spark, tmp_dir).records)
    whole = apply_mode(checked, "strict")
    assert "from_csv" not in whole._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["vehicle_id"], r["row_number"]): r["reject_reasons"] for r in whole.collect()}
    assert {k: v for k, v in found.items() if k[0] == "bad"} == {
        ("bad", 2): ["file_rejected"], ("bad", 3): ["timestamp_invalid"], ("bad", 4): ["file_rejected"]}
    assert [v for k, v in sorted(found.items()) if k[0] == "ok"] == [[]] * 4
    micros = F.unix_micros("timestamp").alias("t")
    expected = sorted(map(tuple, validate.valid_rows(checked).where("vehicle_id = 'ok'").select("row_number", micros, "odometer", "shift_state").collect()))
    for rows in (validate.valid_rows(whole), validate.valid_rows(validate.strict_files(checked))):
        assert sorted(map(tuple, rows.select("row_number", micros, "odometer", "shift_state").collect())) == expected
    rows, bad_files = validate.held_with_bad_files(checked, broadcast_bytes=0)
    assert rows.join(bad_files, "source_file", "left_anti").count() == len(expected) == 4

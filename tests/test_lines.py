"""The CSV line parser: header binding by name, row numbers, odd files."""

import os

import pytest
from pyspark.sql import functions as F

from filetree import write_files
from fleetlake.operators.validate import validate
from fleetlake.sources.csv_files import header_contract, read_csv_directory, read_csv_file, read_uploads
from fleetlake.sources.lines import parse_lines, scan_lines

HEADER = "timestamp,speed,odometer,soc,elevation,shift_state"


def _records(parsed):
    return {
        (r["vehicle_id"], r["row_number"]): r.asDict()
        for r in parsed.records.collect()
    }


def test_reordered_header_extra_column_bom_and_crlf(spark, tmp_dir):
    write_files(tmp_dir, {
        "car-1.csv": "﻿" + HEADER + "\r\n2031-02-03T04:05:06Z,61.25,777.5,40.0,-3.5,R\r\n",
        "car-2.csv": "shift_state,trip,speed,soc,timestamp,elevation,odometer\n"
                     "R,\"a, b\",61,40,2031-02-03T04:05:06Z,-3,777\n",
    })
    parsed = read_csv_directory(spark, tmp_dir)
    recs = _records(parsed)
    one = recs[("car-1", 2)]
    assert one["timestamp"] == "2031-02-03T04:05:06Z"
    assert one["shift_state"] == "R"
    assert one["missing_columns"] == []
    two = recs[("car-2", 2)]
    assert two["speed"] == "61" and two["soc"] == "40" and two["odometer"] == "777"
    assert two["timestamp"] == "2031-02-03T04:05:06Z"


def test_missing_column_is_reported_from_the_header(spark, tmp_dir):
    write_files(tmp_dir, {
        "car-1.csv": "shift_state,soc,odometer,speed,timestamp\nR,40,777,61,2031-02-03T04:05:06Z\n",
        "empty-rows.csv": "odometer,shift_state,speed,timestamp\n",
    })
    parsed = read_csv_directory(spark, tmp_dir)
    contract = {r["source_file"].rsplit("/", 1)[-1]: r for r in header_contract(parsed).collect()}
    assert contract["car-1.csv"]["missing_columns"] == "elevation"
    assert contract["empty-rows.csv"]["missing_columns"] == "elevation,soc"
    assert contract["empty-rows.csv"]["data_rows"] == 0
    assert contract["car-1.csv"]["header_ok"] is False


def test_row_numbers_skip_blank_lines_and_span_splits(spark, tmp_dir):
    rows = [f"2031-02-03T04:{i // 60:02d}:{i % 60:02d}Z,{i},1{i}.5,50,10,D" for i in range(3000)]
    text = HEADER + "\n" + "\n".join(rows[:10]) + "\n\n" + "\n".join(rows[10:]) + "\n"
    write_files(tmp_dir, {"big.csv": text})
    # Tiny splits: the file is read by many tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        parsed = parse_lines(scan_lines(spark, [f"file://{tmp_dir}/big.csv"]))
        got = {r["row_number"]: r["speed"] for r in parsed.records.select("row_number", "speed").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000
    assert got == {i + 2: str(i) for i in range(3000)}


def test_vehicle_id_from_file_name(spark, tmp_dir):
    write_files(tmp_dir, {
        "vehicle.data.csv": HEADER + "\n2031-02-03T04:30:00Z,1,1,1,1,D\n",
        "car 1.csv": HEADER + "\n2031-02-03T04:30:00Z,1,1,1,1,D\n",
        "a+b.csv": HEADER + "\n2031-02-03T04:30:00Z,1,1,1,1,D\n",
        "   .csv": HEADER + "\n2031-02-03T04:30:00Z,1,1,1,1,D\n",
        "notes.txt": "ignored",
    })
    ids = sorted(r["vehicle_id"] for r in read_csv_directory(spark, tmp_dir).records.collect())
    assert ids == ["", "a+b", "car 1", "vehicle.data"]


def test_single_file_import_checks_extension(spark, tmp_dir):
    write_files(tmp_dir, {"upload.CSV": HEADER + "\n2031-02-03T04:30:00Z,1,1,1,1,D\n"})
    parsed = read_csv_file(spark, f"{tmp_dir}/upload.CSV", vehicle_id="car-9")
    assert [r["vehicle_id"] for r in parsed.records.collect()] == ["car-9"]
    with pytest.raises(ValueError, match="A CSV file is required"):
        read_csv_file(spark, f"{tmp_dir}/upload.txt", vehicle_id="car-9")


def test_empty_directory_is_an_error(spark, tmp_dir):
    with pytest.raises(ValueError, match="No CSV files found"):
        read_csv_directory(spark, tmp_dir)


def test_duplicate_header_name_takes_last_and_quotes_are_unescaped(spark, tmp_dir):
    write_files(tmp_dir, {
        "car-1.csv": "timestamp,speed,odometer,soc,elevation,shift_state,speed\n"
                     "2031-02-03T04:30:00Z,1,\"1,5\",50,1,\"D\"\"\",7\n",
    })
    rec = read_csv_directory(spark, tmp_dir).records.first()
    assert rec["speed"] == "7"
    assert rec["odometer"] == "1,5"
    assert rec["shift_state"] == 'D"'


def test_header_only_and_short_rows(spark, tmp_dir):
    write_files(tmp_dir, {
        "only-header.csv": HEADER + "\n",
        "short.csv": HEADER + "\n2031-02-03T04:30:00Z,1\n",
    })
    parsed = read_csv_directory(spark, tmp_dir)
    recs = parsed.records.collect()
    assert len(recs) == 1 and recs[0]["odometer"] is None and recs[0]["speed"] == "1"
    rows = {r["source_file"].rsplit("/", 1)[-1]: r["data_rows"] for r in parsed.files.collect()}
    assert rows == {"only-header.csv": 0, "short.csv": 1}


def test_numbering_does_not_follow_the_split_layout(spark, tmp_dir):
    rows = [f"2031-02-03T04:{i // 60 % 60:02d}:{i % 60:02d}Z,{i},1,50,10,D" for i in range(20_000)]
    write_files(tmp_dir, {f"car-{k}.csv": HEADER + "\n" + "\n".join(rows) + "\n" for k in range(3)})
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    spark.conf.set(names[0], "2")
    spark.conf.set(names[1], "1024")
    try:
        parsed = read_csv_directory(spark, tmp_dir)
        spark.conf.set(names[0], "64")
        got = parsed.records.groupBy("vehicle_id").agg(
            F.count("*").alias("n"), F.min("row_number").alias("a"), F.max("row_number").alias("b"),
            F.count_if(F.col("speed") != (F.col("row_number") - 2).cast("string")).alias("wrong")).collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert [(r.n, r.a, r.b, r.wrong) for r in got] == [(20_000, 2, 20_001, 0)] * 3


def test_files_without_bytes_or_rows_are_judged(spark, tmp_dir):
    write_files(tmp_dir, {"none.csv": "", "only.csv": "soc,speed\n", "good.csv": HEADER + "\n2031-02-03T04:05:06Z,1,1,1,1,D\n"})
    contract = {r["source_file"].rsplit("/", 1)[-1]: r for r in header_contract(read_csv_directory(spark, tmp_dir)).collect()}
    assert contract["none.csv"]["missing_columns"] == "elevation,odometer,shift_state,soc,speed,timestamp"
    assert contract["only.csv"]["missing_columns"] == "elevation,odometer,shift_state,timestamp"
    assert [contract[n]["header_ok"] for n in ("none.csv", "only.csv", "good.csv")] == [False, False, True]
    assert [contract[n]["data_rows"] for n in ("none.csv", "only.csv", "good.csv")] == [0, 0, 1]


def test_uploads_by_relative_path_and_names_with_glob_characters(spark, tmp_dir, monkeypatch):
    row = HEADER + "\n2031-02-03T04:05:06Z,1,1,1,1,D\n"
    write_files(tmp_dir, {"x[1].csv": row, "a b.csv": row, "{c}.csv": row})
    full = [(f"{tmp_dir}/x[1].csv", "v1"), (f"{tmp_dir}/a b.csv", "v2"), (os.path.relpath(f"{tmp_dir}/{{c}}.csv"), "v3")]
    got = {r["source_file"].rsplit("/", 1)[-1]: r["vehicle_id"] for r in read_uploads(spark, full).records.collect()}
    assert sorted(got.values()) == ["v1", "v2", "v3"]
    assert [r["vehicle_id"] for r in read_csv_file(spark, f"{tmp_dir}/x[1].csv", "v9").records.collect()] == ["v9"]


def test_bytes_that_are_not_utf8_are_marked(spark, tmp_dir):
    write_files(tmp_dir, {"car-1.csv": HEADER.encode() + b"\n2031-02-03T04:05:06Z,1,1,1,1,\xff\n2031-02-03T04:05:07Z,1,1,1,1,D\n"})
    checked = validate(read_csv_directory(spark, tmp_dir).records)
    assert [(r.row_number, r.reject_reasons) for r in checked.orderBy("row_number").collect()] == [(2, ["encoding_invalid"]), (3, [])]

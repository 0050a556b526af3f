"""Quoted line breaks: records over several lines and splits, against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from filetree import write_files
from fleetlake.operators.validate import validate
from fleetlake.plans.ingest import load_directory
from fleetlake.sinks.table import read_audit, read_rejects, read_table
from fleetlake.sources import records
from fleetlake.sources.csv_files import csv_source, header_contract, read_csv_directory
from fleetlake.sources.lines import list_files, parse_lines, scan_lines
from fleetlake.streaming.ingest_stream import run_available_now

HEADER = ["timestamp", "speed", "odometer", "soc", "elevation", "shift_state", "note"]


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(rows, header=HEADER):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([header, *rows])
    return out.getvalue()


def random_rows(pick, n):
    notes = ["plain", "two\nlines", 'a "quoted" word', "comma, and\nbreak,\nand \"more\"", "", "\nfirst", "last\n", '"', '"\n"', "x" * 300 + "\n" + "y" * 300]
    return [[f"2031-02-03T04:{i // 60:02d}:{i % 60:02d}Z", str(i), f"1{i}.5", pick.choice(["50", "50\n", "\n50"]), "10", "D", pick.choice(notes)] for i in range(n)]


def read_by_python(text):
    rows = list(csv.DictReader(io.StringIO(text)))
    return {n: [r[c] for c in HEADER[:6]] for n, r in enumerate(rows, start=2)}


def cells(row):
    return [row[c] for c in HEADER[:6]]


def stripped(found):
    return {k: [None if c is None else c.strip() for c in v] for k, v in found.items()}


def test_records_over_splits_equal_pythons_reader(spark, tmp_dir, small_splits):
    pick = random.Random(1)
    files = {f"car-{k}.csv": written(random_rows(pick, 70)) for k in range(3)}
    files["plain.csv"] = written([r[:6] + ["no breaks"] for r in random_rows(pick, 0)] + [["2031-02-03T04:00:00Z", "1", "2", "3", "4", "D", "a, b"]])
    write_files(tmp_dir, files)
    parsed = read_csv_directory(spark, tmp_dir)
    rows = parsed.records.collect()
    for name, text in files.items():
        got = {r["row_number"]: cells(r) for r in rows if r["vehicle_id"] == name[:-4]}
        assert stripped(got) == stripped(read_by_python(text)), name
    contract = {r["source_file"].rsplit("/", 1)[-1]: r for r in header_contract(parsed).collect()}
    assert {n: r["data_rows"] for n, r in contract.items()} == {n: len(read_by_python(t)) for n, t in files.items()}
    assert all(r["reject_reasons"] == [] for r in validate(parsed.records).collect())


def test_states_of_any_quotes_equal_pythons_reader(spark, tmp_dir, small_splits):
    """Malformed lines too: where records begin must not depend on splits or on quotes that open nothing."""
    pick = random.Random(2)
    parts = ['"', '""', ",", "a", "b c", "\n", '"x"', 'y"', ',"', '",']
    files = {}
    for k in range(15):
        body = "".join(pick.choice(parts) for _ in range(pick.randint(1, 60)))
        files[f"f{k:02d}.csv"] = "h\n" + "\n".join(body + str(j) for j in range(12)) + '"\n' + "end\n"
    write_files(tmp_dir, files)
    parsed = read_csv_directory(spark, tmp_dir)
    counts = {r["source_file"].rsplit("/", 1)[-1]: r["data_rows"] for r in parsed.files.collect()}
    expected = {n: sum(1 for row in csv.reader(io.StringIO(t)) if row) - 1 for n, t in files.items()}
    assert counts == expected
    got = {r["f"]: r["n"] for r in parsed.records.groupBy(F.element_at(F.split("source_file", "/"), -1).alias("f")).agg(F.count("*").alias("n")).collect()}
    assert got == {n: c for n, c in expected.items() if c}


def test_line_functions():
    """Both line functions over all short lines, against a walk through the characters."""
    import itertools
    import re

    def ends_inside(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "closing" if c == '"' else "quoted"
            elif state == "closing" and c == '"':
                state = "quoted"
            elif c == ",":
                state = "start"
            elif state == "start" and c == '"':
                state = "quoted"
            else:
                state = "cell"
        return state == "quoted"

    def found(pattern, line):
        return re.match(pattern.replace(r"\z", r"\Z"), line) is not None

    for n in range(9):
        for line in map("".join, itertools.product('",a', repeat=n)):
            assert found(records._OPENS, line) == ends_inside(line, False), line
            stays = '"' not in line or found(records._STAYS, line) or found(records._REOPENS, line)
            assert stays == ends_inside(line, True), line


def test_header_with_a_break_and_bom(spark, tmp_dir):
    text = "﻿" + written([["2031-02-03T04:00:00Z", "1", "2", "3", "4", "D", "x"]], ["timestamp", "speed", "odometer", "soc", "elevation", "shift_state", "note\nof, the trip"])
    write_files(tmp_dir, {"car.csv": text})
    parsed = read_csv_directory(spark, tmp_dir)
    assert [cells(r) for r in parsed.records.collect()] == [["2031-02-03T04:00:00Z", "1", "2", "3", "4", "D"]]
    assert [r["header_ok"] for r in header_contract(parsed).collect()] == [True]


def test_open_quote_takes_the_rest_and_is_not_gathered(spark, tmp_dir, small_splits):
    rows = "".join(f"2031-02-03T04:05:{i % 60:02d}Z,1,2,3,4,D,n{i}\n" for i in range(400))
    text = ",".join(HEADER) + "\n2031-02-03T04:05:06Z,1,2,3,4,D,ok\n" + '2031-02-03T04:05:07Z,1,2,3,4,D,"open\n' + rows
    write_files(tmp_dir, {"car.csv": text})
    lines = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(text.split("\n")[:-1])], "file_path string, block_start long, line_id long, value string")
    broken = lines.select("file_path", "block_start").distinct()
    short, files = records.assemble(lines, broken, record_bytes=1000)
    assert [(r["row"], r["too_long"], len(r["value"]) > 0) for r in short.orderBy("row").collect()] == [(1, False, True), (2, False, True), (3, True, False)]
    assert files.first()["n_records"] == 3
    whole, _ = records.assemble(lines, broken)
    assert len(whole.where("row = 3").first()["value"]) > 10_000
    checked = validate(read_csv_directory(spark, tmp_dir).records).orderBy("row_number").collect()
    assert [r["row_number"] for r in checked] == [2, 3] and checked[0]["reject_reasons"] == []


def test_load_and_stream_take_the_same_rows(spark, tmp_dir, small_splits):
    pick = random.Random(3)
    text = written(random_rows(pick, 80) + [["bad\ntime", "1", "2", "3", "4", "D", "x\ny"]])
    write_files(f"{tmp_dir}/in", {"car-1.csv": text})
    result = load_directory(spark, f"{tmp_dir}/in", f"{tmp_dir}/t", "load", mode="permissive", rejects_path=f"{tmp_dir}/r", audit_path=f"{tmp_dir}/a")
    assert (result.rows_read, result.rows_inserted, result.rows_rejected) == (81, 80, 1)
    assert [(r["row_number"], r["reject_reasons"]) for r in read_rejects(spark, f"{tmp_dir}/r").collect()] == [(82, ["timestamp_invalid"])]
    run_available_now(spark, f"{tmp_dir}/in", f"{tmp_dir}/t2", f"{tmp_dir}/c", audit_path=f"{tmp_dir}/a2", log=lambda m: None)
    keys = ["vehicle_id", "timestamp", "speed", "soc"]
    assert sorted(map(tuple, read_table(spark, f"{tmp_dir}/t2").select(*keys).collect())) == sorted(map(tuple, read_table(spark, f"{tmp_dir}/t").select(*keys).collect()))
    assert read_audit(spark, f"{tmp_dir}/a2").first()["rows_read"] == 81


def test_files_without_breaks_do_not_pay(spark, tmp_dir):
    write_files(tmp_dir, {"car.csv": written([["2031-02-03T04:00:00Z", "1", "2", "3", "4", "D", 'a "b", c']])})
    parsed = read_csv_directory(spark, tmp_dir)
    assert "too_long" not in parsed.records.columns
    assert parsed.records.count() == 1


def test_readers_of_records_do_not_run_the_windows_again(spark, tmp_dir, small_splits):
    pick = random.Random(4)
    write_files(tmp_dir, {f"car-{k}.csv": written(random_rows(pick, 40)) for k in range(2)})
    parsed = read_csv_directory(spark, tmp_dir)
    plan = parsed.records._jdf.queryExecution().optimizedPlan()
    leaves = [plan.collectLeaves().apply(i).toString() for i in range(plan.collectLeaves().size())]
    # Lines by themselves, parts and their sizes, each with the row of its split; then the split table.
    assert len(leaves) <= 12, len(leaves)
    assert parsed.records.count() == 80


def test_files_with_and_without_breaks_together(spark, tmp_dir, small_splits):
    """By broadcast and by shuffle, held in the scratch folder and cached: the same records."""
    pick = random.Random(5)
    texts = {f"car-{k}.csv": written(random_rows(pick, 30)) for k in range(2)}
    texts["plain.csv"] = written([[f"2031-02-03T04:00:{i:02d}Z", str(i), "2", "3", "4", "D", "a, b"] for i in range(30)])
    write_files(tmp_dir, texts)
    source = csv_source(spark, tmp_dir)
    for options in ({}, {"broadcast_bytes": 0}, {"cache": True}):
        parsed = parse_lines(scan_lines(spark, source), listing=list_files(source), **options)
        rows = parsed.records.collect()
        for name, text in texts.items():
            got = {r["row_number"]: cells(r) for r in rows if r["vehicle_id"] == name[:-4]}
            assert stripped(got) == stripped(read_by_python(text)), (name, options)
            assert not any(r["missing_columns"] for r in rows)
        assert sum(r["data_rows"] for r in parsed.files.collect()) == 90
        parsed.release()


def test_parser_and_validation_are_compiled_in_methods_the_jit_takes(spark, tmp_dir):
    """A generated method of over 8000 bytes is only interpreted, several times slower."""
    import re

    write_files(tmp_dir, {"car.csv": written([["2031-02-03T04:00:00Z", "1", "2", "3", "4", "D", "x\ny"]]), "plain.csv": written([["2031-02-03T04:00:00Z", "1", "2", "3", "4", "D", "x"]])})
    checked = validate(read_csv_directory(spark, tmp_dir).records)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(checked.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, sizes

"""Exports: column order, ISO text, NULLs kept, per-vehicle folders, manifest."""

import datetime as dt
import glob
import json
import os

import pytest

from fleetlake.plans.export import VehicleNotFound, export_downloads, export_fleet, export_manifest, export_vehicle
from fleetlake.schema import EXPORT_COLUMNS, TELEMETRY
from fleetlake.sinks.files import read_records


@pytest.fixture()
def table(spark):
    rows = [
        (1, "car-1", dt.datetime(2026, 7, 21, 10, 30, tzinfo=dt.timezone.utc), 45.5, 12000.25, 82.0, 35.2, "D"),
        (2, "car-1", dt.datetime(2026, 7, 21, 10, 29, 0, 500000, tzinfo=dt.timezone.utc), None, 12000.0, 82.0, 35.0, None),
        (3, "vehicle/one:ü", dt.datetime(2026, 7, 21, 9, 0, tzinfo=dt.timezone.utc), 1.0, 1.0, 1.0, 1.0, "P"),
    ]
    return spark.createDataFrame(rows, TELEMETRY)


def _lines(folder, pattern):
    out = []
    for path in sorted(glob.glob(os.path.join(folder, "**", pattern), recursive=True)):
        with open(path, encoding="utf-8") as fh:
            out += fh.read().splitlines()
    return out


def test_csv_export_of_one_vehicle(spark, table, tmp_dir):
    manifest = export_vehicle(spark, table, "car-1", f"{tmp_dir}/out").first()
    assert (manifest["file_name"], manifest["rows"]) == ("car-1_vehicle_data.csv", 2)
    header = ",".join(EXPORT_COLUMNS)
    parts = sorted(glob.glob(f"{tmp_dir}/out/part-*.csv"))
    rows = []
    for part in parts:  # every part is a complete CSV file: header, then rows in time order
        with open(part, encoding="utf-8") as fh:
            lines = fh.read().splitlines()
        assert lines[0] == header
        rows += lines[1:]
    assert rows == [
        "car-1,2026-07-21T10:29:00.500000+00:00,,12000.0,82.0,35.0,",
        "car-1,2026-07-21T10:30:00+00:00,45.5,12000.25,82.0,35.2,D",
    ]


def test_json_export_keeps_nulls_and_non_ascii(spark, table, tmp_dir):
    manifest = {r["vehicle_id"]: r for r in export_fleet(table, f"{tmp_dir}/out", "json").collect()}
    assert manifest["vehicle/one:ü"]["file_name"] == "vehicle_one___vehicle_data.json"
    records = [json.loads(x) for x in _lines(f"{tmp_dir}/out", "part-*.json")]
    by_ts = {r["timestamp"]: r for r in records}
    assert by_ts["2026-07-21T10:29:00.500000+00:00"]["speed"] is None
    assert "shift_state" in by_ts["2026-07-21T10:29:00.500000+00:00"]
    assert any(r["vehicle_id"] == "vehicle/one:ü" for r in records)
    back = read_records(spark, f"{tmp_dir}/out", "json")
    assert back.count() == 3 and back.columns == list(EXPORT_COLUMNS)


def test_unknown_vehicle_is_not_found(spark, table, tmp_dir):
    with pytest.raises(VehicleNotFound):
        export_vehicle(spark, table, "nobody", f"{tmp_dir}/out")


def test_manifest_counts_what_the_files_hold(spark, table, tmp_dir):
    out = f"{tmp_dir}/out[1]"
    manifest = export_fleet(table, out, "json")
    part = [p for p in glob.glob(os.path.join(glob.escape(out), "**", "part-*.json"), recursive=True) if "vehicle=car-1" in p][0]
    with open(part) as fh:
        lines = fh.read().splitlines()
    os.rename(part, f"{tmp_dir}/aside.json")
    for crc in glob.glob(os.path.join(glob.escape(os.path.dirname(part)), ".*.crc")):
        os.rename(crc, f"{tmp_dir}/aside.crc")
    held = {r["vehicle_id"]: r["rows"] for r in manifest_of(spark, out).collect()}
    assert held.get("car-1", 0) == 2 - len(lines) and held["vehicle/one:ü"] == 1
    assert manifest.columns == ["vehicle_id", "file_name", "format", "rows"]


def manifest_of(spark, out):
    return export_manifest(read_records(spark, out, "json"), "json")


def _downloads(manifest):
    """Each vehicle's file by its manifest: parts end to end, each at the byte that the manifest names."""
    from urllib.parse import unquote, urlparse

    out, parts = {}, {}
    for r in sorted(manifest.collect(), key=lambda r: (r.vehicle_id, r.offset)):
        path = r.part if os.path.exists(urlparse(r.part).path) else unquote(r.part)
        with open(urlparse(path).path, "rb") as fh:
            data = fh.read()
        assert len(out.get(r.vehicle_id, b"")) == r.offset and len(data) == r.length
        out[r.vehicle_id] = out.get(r.vehicle_id, b"") + data
        parts[r.vehicle_id] = parts.get(r.vehicle_id, 0) + 1
    return out, parts


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_parts_end_to_end_are_one_valid_file(spark, tmp_dir, fmt):
    import csv
    import io

    start = dt.datetime(2031, 1, 1, tzinfo=dt.timezone.utc)
    sizes = {"busy": 900, 'a "b", c/ü:*': 40, "12": 1, "one\nline": 2}
    rows = [(i, v, start + dt.timedelta(seconds=37 * i), None if i % 3 else i / 7, float(i), 5.0, 1.0, "D" if i % 2 else None)
            for v, n in sizes.items() for i in range(n)]
    telemetry = spark.createDataFrame(rows, TELEMETRY).repartition(5)
    files, parts = _downloads(export_downloads(telemetry, f"{tmp_dir}/out", fmt, file_rows=100))
    assert set(files) == set(sizes) and parts.pop("busy") > 1 and set(parts.values()) == {1}
    for vehicle, data in files.items():
        if fmt == "csv":
            records = list(csv.DictReader(io.StringIO(data.decode(), newline="")))
            assert data.decode().startswith(",".join(EXPORT_COLUMNS) + "\n")
        else:
            records = [json.loads(x) for x in data.decode().splitlines()]
        assert [r["vehicle_id"] for r in records] == [vehicle] * sizes[vehicle]
        assert [float(r["odometer"]) for r in records] == [float(i) for i in range(sizes[vehicle])]  # in time order
        assert [r["shift_state"] or None for r in records] == ["D" if i % 2 else None for i in range(sizes[vehicle])]


def test_downloads_of_an_empty_table_and_a_wrong_format(spark, table, tmp_dir):
    assert export_downloads(table.limit(0), f"{tmp_dir}/out").collect() == []
    with pytest.raises(ValueError):
        export_downloads(table, f"{tmp_dir}/xml", "xml")

"""Ported case tables for the scalar functions (null tokens, numbers, time, names)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlake.functions import (
    export_file_name,
    is_null_token,
    iso_text,
    normalise_shift_state,
    nullable_float,
    nullable_float_error,
    nullable_string,
    parse_iso_timestamp,
    parse_with_patterns,
    required_float,
    required_float_reason,
    safe_file_name,
    vehicle_id_from_path,
)


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_null_tokens(spark):
    yes = [None, "", "   ", "NULL", "null", "None", "N/A", "  n/a  ", "\tNULL\r\n"]
    no = ["0", "text", "NULLS", "n / a"]
    assert _eval(spark, yes, is_null_token) == [True] * len(yes)
    assert _eval(spark, no, is_null_token) == [False] * len(no)


def test_nullable_float(spark):
    values = [None, "", "NULL", "N/A", "12.5", " 42 ", "0", "not-a-number", "1d", "1_000", "inf", "-nan", ".5", "5."]
    got = _eval(spark, values, nullable_float)
    assert got[:4] == [None] * 4
    assert got[4:7] == [12.5, 42.0, 0.0]
    assert got[7] is None and got[8] is None
    assert got[9] == 1000.0 and got[10] == float("inf")
    assert got[11] != got[11]  # NaN
    assert got[12:] == [0.5, 5.0]
    errors = _eval(spark, values, nullable_float_error)
    assert errors == [False] * 7 + [True, True] + [False] * 5


def test_nullable_string(spark):
    assert _eval(spark, [None, "", "NULL", "none", " D ", "park"], nullable_string) == [None, None, None, None, "D", "park"]


def test_required_float(spark):
    values = [None, "", "   ", "12.5", " 42 ", "0", "NULL", "abc"]
    assert _eval(spark, values, required_float) == [None, None, None, 12.5, 42.0, 0.0, None, None]
    reasons = _eval(spark, values, lambda c: required_float_reason(c, "odometer"))
    assert reasons == ["odometer_empty"] * 3 + [None] * 3 + ["odometer_not_numeric"] * 2


def test_basic_format_other_separators_and_years(spark):
    taken = ["20260721T103000", "20260721", "2026-07-21_10:31:00", "20260721 10", "2026-07-21x1031", "20260721T103000.25+0200",
             "2026-07-21T103000Z", "9999-12-31T23:59:59Z", "0001-01-01T00:00:00Z"]
    got = _eval(spark, taken, lambda c: F.unix_micros(parse_iso_timestamp(c)))
    for text, micros in zip(taken, got):
        ref = dt.datetime.fromisoformat(text)
        ref = ref if ref.tzinfo else ref.replace(tzinfo=dt.timezone.utc)
        assert micros == (ref - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1), text
    refused = ["0000-01-01T00:00:00Z", "9999-12-31T23:30:00-05:00", "0001-01-01T00:30:00+02:00", "2026072", "20260721T1030000",
               "2026-07-21T10:30:00ZZ", "202607-21"]
    assert _eval(spark, refused, parse_iso_timestamp) == [None] * len(refused)


def test_long_cells_are_matched_without_recursion(spark):
    long = ["1_" * 50_000 + "1", "9" * 50_000 + "x", "1" * 300 + "." + "5" * 50_000, "1_" * 50_000]
    got = _eval(spark, long, required_float)
    assert got[0] == float("inf") and got[1] is None and got[2] == float("1" * 300) and got[3] is None


def test_iso_timestamps(spark):
    values = [
        "2026-07-21T10:30:00Z",
        "2026-07-21T10:31:00+00:00",
        "2026-07-21T12:30:00+02:00",
        "2026-07-21T10:30:00.4",
        "2022-07-12 16:42:25.435",
        "2026-07-21",
        "2026-07-21T10",
        "2026-07-21T10:30:00,5",
        "not-a-timestamp",
        "20260230T103000",
        "10:30:00",
        "2026",
        "2026-02-30",
        "",
    ]
    got = _eval(spark, values, parse_iso_timestamp)
    utc = dt.timezone.utc

    def at(*a):
        return dt.datetime(*a)

    expected = [
        at(2026, 7, 21, 10, 30), at(2026, 7, 21, 10, 31), at(2026, 7, 21, 10, 30),
        at(2026, 7, 21, 10, 30, 0, 400000), at(2022, 7, 12, 16, 42, 25, 435000),
        at(2026, 7, 21), at(2026, 7, 21, 10), at(2026, 7, 21, 10, 30, 0, 500000),
        None, None, None, None, None, None,
    ]
    # Collected timestamps are local-naive in the driver's zone; compare as UTC.
    as_utc = [g.astimezone(utc).replace(tzinfo=None) if g is not None else None for g in got]
    assert as_utc == expected


def test_stream_patterns_need_a_fraction(spark):
    values = ["2022-07-12 16:42:25.435", "2022-07-12 16:42:25.4", "2026-07-21T12:30:00.123+02:00", "2026-07-21T10:30:00Z"]
    got = _eval(spark, values, parse_with_patterns)
    assert [g is None for g in got] == [False, False, False, True]


def test_shift_state(spark):
    assert _eval(spark, [" d ", "", "  ", "p", None], normalise_shift_state) == ["D", None, None, "P", None]


def test_vehicle_id_from_path(spark):
    paths = [
        "file:/data/car-1.csv",
        "file:/data/3f2504e0-4f89-11d3-9a0c-0305e82c3301.csv",
        "file:/data/vehicle.data.csv",
        "file:/data/car%201.csv",
        "file:/data/a+b.csv",
        "file:/data/%20%20%20.csv",
        "s3a://bucket/x/.csv",
    ]
    assert _eval(spark, paths, vehicle_id_from_path) == [
        "car-1", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "vehicle.data", "car 1", "a+b", "", ".csv",
    ]


def test_safe_file_names(spark):
    ids = ["vehicle/one:dangerous", "", "../../car one", "car-1.x_y"]
    assert _eval(spark, ids, safe_file_name) == ["vehicle_one_dangerous", "vehicle", ".._.._car_one", "car-1.x_y"]
    assert _eval(spark, ["a/b"], lambda c: export_file_name(c, "json")) == ["a_b_vehicle_data.json"]


@pytest.mark.parametrize(
    "value,text",
    [
        ("2026-07-21 10:30:00", "2026-07-21T10:30:00+00:00"),
        ("2026-07-21 10:30:00.5", "2026-07-21T10:30:00.500000+00:00"),
        ("2022-07-12 16:42:25.435", "2022-07-12T16:42:25.435000+00:00"),
    ],
)
def test_iso_text_like_isoformat(spark, value, text):
    got = _eval(spark, [value], lambda c: iso_text(c.cast("timestamp")))
    assert got == [text]

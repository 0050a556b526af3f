"""Differential tests: the Spark column functions against Python's own parsers,
which define the reference's semantics (``float`` and ``datetime.fromisoformat``)."""

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlake.functions import parse_iso_timestamp, to_double

_pieces = st.sampled_from(
    ["", "+", "-", "0", "1", "7", "42", "_", "1_0", ".", ".5", "e", "E", "e-3", "E+2", "inf", "Infinity",
     "nan", "NaN", "d", "f", "x", "0x1", " ", "\t", "١"]
)
number_like = st.lists(_pieces, min_size=1, max_size=5).map("".join)


def _python_float(text):
    try:
        return float(text)
    except ValueError:
        return None


@settings(max_examples=60, deadline=None)
@given(st.lists(number_like, min_size=20, max_size=20))
def test_numbers_match_python_float(spark, texts):
    texts = [t for t in texts if t.isascii()]  # non-ASCII digits are outside the contract
    if not texts:
        return
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(to_double("t")).collect()]
    for text, value in zip(texts, got):
        expected = _python_float(text)
        if expected is None:
            assert value is None, (text, value)
        elif math.isnan(expected):
            assert value is not None and math.isnan(value), (text, value)
        else:
            assert value == expected, (text, value, expected)


_dates = st.dates(min_value=dt.date(1971, 1, 1), max_value=dt.date(2099, 12, 31))
_times = st.times()
_offsets = st.sampled_from(["", "Z", "+00:00", "+02:00", "-05:30", "+0530", "+01"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(_dates, _times, st.sampled_from(["T", " "]), st.integers(0, 4), _offsets),
                min_size=10, max_size=10))
def test_iso_timestamps_match_fromisoformat(spark, parts):
    texts = []
    for day, t, sep, shape, off in parts:
        if shape == 0:
            texts.append(day.isoformat())
            continue
        clock = [f"{t.hour:02d}", f"{t.hour:02d}:{t.minute:02d}", f"{t.hour:02d}:{t.minute:02d}:{t.second:02d}",
                 f"{t.hour:02d}:{t.minute:02d}:{t.second:02d}.{t.microsecond:06d}"][shape - 1]
        texts.append(f"{day.isoformat()}{sep}{clock}{off}")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.unix_micros(parse_iso_timestamp("t"))).collect()]
    for text, micros in zip(texts, got):
        ref = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        if ref.tzinfo is None:
            ref = ref.replace(tzinfo=dt.timezone.utc)  # naive text is UTC by contract
        expected = (ref - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
        assert micros == expected, (text, micros, expected)


_cell_pieces = st.sampled_from(["", " ", "\t", "\r\n", "null", "NULL", "None", "n/a", "N/A", "na", "d", "D", "pu", "0"])
cell_like = st.lists(_cell_pieces, min_size=0, max_size=4).map("".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(cell_like, min_size=15, max_size=15))
def test_tokens_and_shift_state_match_python_rules(spark, cells):
    from fleetlake.functions import is_null_token, nullable_string, normalise_shift_state

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = df.orderBy("i").select(
        is_null_token("c"), nullable_string("c"), normalise_shift_state("c")
    ).collect()
    for cell, (flag, text, shift) in zip(cells, got):
        token = cell.strip().upper() in {"", "NULL", "NONE", "N/A"}
        assert flag == token, cell
        assert text == (None if token else cell.strip()), cell
        assert shift == (cell.strip().upper() or None), cell


_name_pieces = st.sampled_from(["car", "-", "1", " ", ".", "data", "+", "%", "_", "é", "csv", "x"])
file_names = st.lists(_name_pieces, min_size=1, max_size=5).map(lambda p: "".join(p) + ".csv")


@settings(max_examples=30, deadline=None)
@given(st.lists(file_names, min_size=10, max_size=10))
def test_vehicle_id_matches_pathlib_stem(spark, names):
    from pathlib import Path
    from urllib.parse import quote

    from fleetlake.functions import vehicle_id_from_path

    uris = [f"file:/data/in/{quote(n)}" for n in names]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "i int, u string")
    got = [r[0] for r in df.orderBy("i").select(vehicle_id_from_path("u")).collect()]
    for name, vid in zip(names, got):
        assert vid == Path(name).stem.strip(), (name, vid)

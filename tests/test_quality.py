"""Data tests find seeded violations."""

import datetime as dt

from fleetlake.operators import quality
from fleetlake.schema import TELEMETRY


def test_seeded_violations(spark):
    ts = dt.datetime(2026, 7, 21, 10, 0)
    rows = [
        (1, "a", ts, 1.0, 1.0, 50.0, 1.0, "D"),
        (1, "a", ts, 1.0, 1.0, 101.0, 1.0, "D"),
        (2, "b", ts, None, 1.0, -1.0, 1.0, None),
    ]
    df = spark.createDataFrame(rows, TELEMETRY)
    assert quality.not_null(df, "speed").count() == 1
    assert [tuple(r) for r in quality.unique(df, "id").collect()] == [(1, 2)]
    assert quality.accepted_range(df, "soc", 0, 100).count() == 2
    assert quality.unique_combination(df, ["vehicle_id", "timestamp"]).count() == 1
    checks = [
        quality.Check("m", "not_null", ("speed",)),
        quality.Check("m", "unique", ("id",)),
        quality.Check("m", "accepted_range", ("soc",), 0, 100),
        quality.Check("m", "unique_combination", ("vehicle_id", "timestamp")),
    ]
    got = {r["check_index"]: r["failures"] for r in quality.check_counts(df, checks).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1}

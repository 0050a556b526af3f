"""Every registered query equals its SQL oracle (DuckDB) on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from fleetlake.catalog import ORACLES, QUERIES  # noqa: E402
from check_oracles import TABLES, rows_key  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "vehicle_id", "observed_hour", "observation_count", "average_speed",
        "minimum_state_of_charge_pct", "maximum_state_of_charge_pct", "distance_travelled",
    ]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert rows_key(df.columns, rows) == rows_key(ocols, orows)

"""Each query that SQL can express against its SQL, on the smallest scale."""

import duckdb
import pytest

from fleetlake.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(round(float(r[i]), 6) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order) for r in rows),
        key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got.columns, got.collect()) == canonical(expected.columns, expected.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

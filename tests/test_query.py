"""List endpoint: parameter checks, envelope, null order, pages, lookups, stats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import query, stats
from fleetlake.schema import TELEMETRY


def _table(spark, rows):
    return spark.createDataFrame(rows, TELEMETRY)


def _row(i, vid, minute, speed, shift="D"):
    return (i, vid, dt.datetime(2026, 7, 21, 10, minute), speed, 12000.0 + i, 80.0 - i, 35.0, shift)


@pytest.fixture()
def rows(spark):
    data = [
        _row(1, "car-1", 0, 45.5), _row(2, "car-1", 1, None), _row(3, "car-1", 2, 10.0),
        _row(4, "car-1", 3, None), _row(5, "car-1", 4, 10.0), _row(6, "car-2", 0, 99.0),
    ]
    return _table(spark, data)


@pytest.mark.parametrize(
    "kwargs",
    [
        {"vehicle_id": ""},
        {"vehicle_id": "car-1", "page": 0},
        {"vehicle_id": "car-1", "page_size": 0},
        {"vehicle_id": "car-1", "page_size": 501},
        {"vehicle_id": "car-1", "sort_by": "vehicle_id"},
        {"vehicle_id": "car-1", "sort_order": "up"},
        {"vehicle_id": "car-1", "start": "2026-07-21T11:00:00Z", "end": "2026-07-21T10:00:00Z"},
    ],
)
def test_bad_parameters_fail_before_any_job(kwargs):
    with pytest.raises(ValueError):
        query.PageRequest(**kwargs)


def test_envelope_counts_pages(spark, rows):
    req = query.PageRequest("car-1", page_size=2)
    items, meta = query.page(rows, req)
    m = meta.first()
    assert (m["page"], m["page_size"], m["total"], m["pages"]) == (1, 2, 5, 3)
    assert [r["id"] for r in items.collect()] == [1, 2]


def test_empty_result_has_zero_pages(spark, rows):
    meta = query.page_meta(rows, query.PageRequest("nobody")).first()
    assert (meta["total"], meta["pages"], meta["page_size"]) == (0, 0, 50)


def test_page_past_the_end_is_empty_with_total(spark, rows):
    items, meta = query.page(rows, query.PageRequest("car-1", page=9, page_size=2))
    assert items.count() == 0 and meta.first()["total"] == 5


def test_nulls_last_ascending_first_descending(spark, rows):
    asc = query.page_items(rows, query.PageRequest("car-1", sort_by="speed", sort_order="asc"))
    desc = query.page_items(rows, query.PageRequest("car-1", sort_by="speed", sort_order="desc"))
    assert [r["id"] for r in asc.collect()] == [3, 5, 1, 2, 4]
    assert [r["id"] for r in desc.collect()] == [2, 4, 1, 3, 5]


def test_union_of_pages_is_the_sorted_table(spark, rows):
    seen = []
    for page in range(1, 4):
        req = query.PageRequest("car-1", page=page, page_size=2, sort_by="speed", sort_order="desc")
        seen += [r["id"] for r in query.page_items(rows, req).collect()]
    assert seen == [2, 4, 1, 3, 5]


def test_keyset_page_matches_offset_page(spark, rows):
    req = query.PageRequest("car-1", page_size=2, sort_by="speed", sort_order="desc")
    after = query.page_after(rows, req, after_value=None, after_id=4)
    assert [r["id"] for r in after.collect()] == [1, 3]
    req_asc = query.PageRequest("car-1", page_size=2, sort_by="speed", sort_order="asc")
    after_asc = query.page_after(rows, req_asc, after_value=10.0, after_id=5)
    assert [r["id"] for r in after_asc.collect()] == [1, 2]


def test_time_range_is_inclusive_and_zone_aware(spark, rows):
    req = query.PageRequest("car-1", start="2026-07-21T12:01:00+02:00", end=dt.datetime(2026, 7, 21, 10, 3))
    assert [r["id"] for r in query.page_items(rows, req).collect()] == [2, 3, 4]


def test_point_lookup(spark, rows):
    assert query.point_lookup(rows, 3).first()["vehicle_id"] == "car-1"
    assert query.point_lookup(rows, 999).isEmpty()


def test_dashboard_stats_and_legend(spark, rows):
    scope = stats.in_scope(rows, ["car-1", "car-2"])
    s = stats.dashboard_stats(scope).first()
    assert s["observations"] == 6
    assert s["avg_speed"] == pytest.approx((45.5 + 10 + 10 + 99) / 4)
    legend = {r["field"]: r for r in stats.series_legend(stats.series_speed_soc(scope, ordered=False)).collect()}
    assert legend["speed"]["last_not_null"] == 10.0  # 10:04 is the last non-NULL speed
    assert [r[0] for r in stats.distinct_vehicles(rows).collect()] == ["car-1", "car-2"]


def test_long_id_list_becomes_a_semi_join(spark, rows):
    ids = ["car-1"] + [f"x{i}" for i in range(query.MAX_INLINE_IDS + 5)]
    assert query.filter_vehicles(rows, ids).count() == 5


def test_chart_series_drops_nulls(spark, rows):
    series = query.chart_series(query.filter_vehicle(rows, "car-1"))
    counts = {r["field"]: r["count"] for r in series.groupBy("field").count().collect()}
    assert counts == {"speed": 3, "odometer": 5, "soc": 5, "elevation": 5}
    assert series.filter(F.col("value").isNull()).count() == 0


@pytest.fixture(scope="module")
def many(spark):
    """Ties of a third, NULLs, NaN, infinities and signed zeros in ``speed``; few letters in ``shift_state``."""
    i = F.col("id")
    speed = (
        F.when(i % 3 == 0, 7.0).when(i % 7 == 1, F.lit(None)).when(i % 11 == 2, float("nan")).when(i % 13 == 3, float("inf"))
        .when(i % 17 == 4, -0.0).when(i % 19 == 5, 0.0).otherwise((i * 37 % 101).cast("double"))
    )
    return spark.range(1, 1201).repartition(3, "id").select(
        "id", F.lit("v").alias("vehicle_id"), F.timestamp_micros(i % 400 * 1_000_003 - 9_000_000).alias("timestamp"), speed.alias("speed"),
        i.cast("double").alias("odometer"), F.lit(50.0).alias("soc"), (i * 7919 % 1201).cast("double").alias("elevation"),
        F.when(i % 5 > 0, F.substring(F.lit("DPRNé"), (i % 5).cast("int") + 1, F.lit(1))).alias("shift_state")).persist()


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("field", query.SORT_FIELDS)
def test_deep_pages_are_the_pages(spark, many, field, order):
    for page, size in ((1, 50), (9, 50), (3, 400), (25, 50)):
        req = query.PageRequest("v", page=page, page_size=size, sort_by=field, sort_order=order)
        want = [r["id"] for r in query.page_items(many, req).collect()]
        assert [r["id"] for r in query.page_deep(many, req, most_rows=40).collect()] == want, (field, order, page)


def test_deep_page_sorts_few_rows(spark, many):
    req = query.PageRequest("v", page=14, page_size=20, sort_by="speed")
    parts = query._deep_parts(query.filtered(many, req), ("speed", "id"), False, req.offset, 20, 60)
    assert sum(size for _, _, size in parts) == 20 and all(rows.count() <= 60 for rows, _, _ in parts)
    same = many.withColumn("id", F.lit(4).cast("long"))  # nothing to tell them apart
    assert query.page_deep(same, query.PageRequest("v", page=10, page_size=50, sort_by="soc"), most_rows=40).count() == 50
    none = query.page_deep(many.limit(0), query.PageRequest("v", page=9), most_rows=40)
    assert none.collect() == [] and none.columns == many.columns

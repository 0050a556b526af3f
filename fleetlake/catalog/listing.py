"""Registered queries: the list endpoint (filter, sort, page), lookup, chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.catalog.registry import (
    LOOKUP_ID,
    RANGE_END,
    RANGE_START,
    TELEMETRY_CTE,
    VEHICLE,
    register,
    with_ctes,
)
from fleetlake.operators import query
from fleetlake.sources.tables import driver_telemetry

_VEHICLE = f"vehicle_id = '{VEHICLE}'"
_RANGE = f""""timestamp" >= TIMESTAMP '{RANGE_START}' AND "timestamp" <= TIMESTAMP '{RANGE_END}'"""

# Two pages of the list endpoint: a descending sort (NULLs first) on a
# nullable field, and a deeper ascending page (NULLs last) in a time range.
SORT_REQUEST = query.PageRequest(VEHICLE, page=1, page_size=500, sort_by="speed", sort_order="desc")
PAGE_REQUEST = query.PageRequest(
    VEHICLE, start=RANGE_START, end=RANGE_END, page=3, page_size=100, sort_by="speed", sort_order="asc"
)


def _page_oracle(order: str, where: str, offset: int, size: int) -> str:
    return with_ctes(TELEMETRY_CTE) + f"""SELECT * FROM (
    SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM telemetry WHERE {where}
) p WHERE position > {offset} AND position <= {offset + size}"""


@register("filter_vehicle", with_ctes(TELEMETRY_CTE) + f"SELECT * FROM telemetry WHERE {_VEHICLE}")
def filter_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return query.filter_vehicle(driver_telemetry(spark, sf_dir), VEHICLE)


@register(
    "filter_time_range",
    with_ctes(TELEMETRY_CTE) + f"SELECT * FROM telemetry WHERE {_VEHICLE} AND {_RANGE}",
)
def filter_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inclusive range on one vehicle."""
    df = query.filter_vehicle(driver_telemetry(spark, sf_dir), VEHICLE)
    return query.filter_time_range(df, RANGE_START, RANGE_END)


@register(
    "count_in_range",
    with_ctes(TELEMETRY_CTE) + f"SELECT count(*) AS total FROM telemetry WHERE {_VEHICLE} AND {_RANGE}",
)
def count_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return query.count_in_range(driver_telemetry(spark, sf_dir), VEHICLE, RANGE_START, RANGE_END)


@register(
    "sort_nulls",
    _page_oracle("speed DESC NULLS FIRST, id ASC", _VEHICLE, SORT_REQUEST.offset, SORT_REQUEST.page_size),
)
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: speed descending, NULLs first, id tie-break; ``position`` is the rank."""
    return query.page_items(driver_telemetry(spark, sf_dir), SORT_REQUEST, with_position=True)


@register(
    "page",
    _page_oracle(
        "speed ASC NULLS LAST, id ASC", f"{_VEHICLE} AND {_RANGE}", PAGE_REQUEST.offset, PAGE_REQUEST.page_size
    ),
)
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: third page of 100 in a time range, ascending, NULLs last."""
    return query.page_items(driver_telemetry(spark, sf_dir), PAGE_REQUEST, with_position=True)


@register(
    "page_meta",
    with_ctes(TELEMETRY_CTE)
    + f"""SELECT {PAGE_REQUEST.page} AS page, {PAGE_REQUEST.page_size} AS page_size, count(*) AS total,
       CAST(ceil(count(*) / {PAGE_REQUEST.page_size}.0) AS BIGINT) AS pages
FROM telemetry WHERE {_VEHICLE} AND {_RANGE}""",
)
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page envelope without items."""
    return query.page_meta(driver_telemetry(spark, sf_dir), PAGE_REQUEST)


@register("point_lookup", with_ctes(TELEMETRY_CTE) + f"SELECT * FROM telemetry WHERE id = {LOOKUP_ID}")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5."""
    return query.point_lookup(driver_telemetry(spark, sf_dir), LOOKUP_ID)


@register(
    "chart_series",
    with_ctes(TELEMETRY_CTE)
    + "\n UNION ALL\n".join(
        f"""SELECT id, vehicle_id, "timestamp", '{f}' AS field, {f} AS value
FROM telemetry WHERE {_VEHICLE} AND {f} IS NOT NULL"""
        for f in ("speed", "odometer", "soc", "elevation")
    ),
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chartable field of one vehicle as (timestamp, field, value)."""
    return query.chart_series(query.filter_vehicle(driver_telemetry(spark, sf_dir), VEHICLE)).select(
        "id", "vehicle_id", "timestamp", "field", F.col("value")
    )

"""Fleet statistics and dashboard series.

Every stat is a global aggregate over a filtered scan: partial aggregation in
each task, one tiny final merge. ``dashboard_stats`` answers the three stat
panels with one scan instead of three.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.operators.query import filter_time_range, filter_vehicles


def in_scope(
    df: DataFrame,
    vehicle_ids: list[str] | tuple[str, ...],
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    date_col: str | None = None,
) -> DataFrame:
    """F2 + F3: the dashboard's ``vehicle IN (…) AND time filter``."""
    return filter_time_range(filter_vehicles(df, vehicle_ids), start, end, date_col=date_col)


def stat_count(scope: DataFrame) -> DataFrame:
    """A3: observations in range."""
    return scope.agg(F.count(F.lit(1)).alias("value"))


def stat_avg(scope: DataFrame, column: str) -> DataFrame:
    """A4/A5: mean of a column (NULLs skipped); NULL when nothing is in range."""
    return scope.agg(F.avg(column).alias("value"))


def dashboard_stats(scope: DataFrame) -> DataFrame:
    """A3–A5 in one pass: ``observations, avg_soc, avg_speed``."""
    return scope.agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("soc").alias("avg_soc"),
        F.avg("speed").alias("avg_speed"),
    )


def series_speed_soc(scope: DataFrame, ordered: bool = True) -> DataFrame:
    """``(time, speed, soc)`` by time. Sorting is a range shuffle;
    pass ``ordered=False`` when the consumer orders or only aggregates."""
    series = scope.select(F.col("timestamp").alias("time"), "speed", "soc")
    return series.orderBy("time") if ordered else series


def series_legend(series: DataFrame, fields: tuple[str, ...] = ("speed", "soc")) -> DataFrame:
    """Per series, mean and last non-NULL value by time (legend ``mean``,
    ``lastNotNull``). One grouped aggregate over the unpivoted series; ties on
    time resolve to the larger value so the answer is deterministic."""
    long = series.unpivot(["time"], list(fields), "field", "value").filter(F.col("value").isNotNull())
    return long.groupBy("field").agg(
        F.avg("value").alias("mean"),
        F.max_by("value", F.struct("time", "value")).alias("last_not_null"),
    )


def distinct_vehicles(df: DataFrame) -> DataFrame:
    """The dashboard's vehicle picker, ordered."""
    return df.select("vehicle_id").distinct().orderBy("vehicle_id")

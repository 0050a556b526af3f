"""List queries: filters, null-aware sort, offset pages, lookups, series.

Parameter checks (F4) raise ``ValueError`` before any Spark job starts.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlake.schema import (
    DEFAULT_PAGE_SIZE,
    MAX_PAGE_SIZE,
    SORT_FIELDS,
    SORT_ORDERS,
)

# Lists up to this many ids are inlined as an IN predicate (pushed to the
# scan); longer lists become a semi join against a small DataFrame, broadcast
# only up to MAX_BROADCAST_IDS (about 100 bytes each), shuffled beyond.
MAX_INLINE_IDS = 10_000
MAX_BROADCAST_IDS = 1_000_000


def to_utc_naive(value: datetime | str | None) -> datetime | None:
    """Aware → UTC wall time; naive is taken as UTC; ISO text is parsed."""
    if value is None:
        return None
    if isinstance(value, str):
        value = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    if not isinstance(value, datetime):
        raise ValueError(f"not a timestamp: {value!r}")
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def timestamp_literal(value: datetime | str) -> Column:
    """A timestamp literal that does not depend on the Python process's zone."""
    naive = to_utc_naive(value)
    return F.lit(naive.isoformat(sep=" ")).cast("timestamp")


def _date_literal(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


@dataclass(frozen=True)
class PageRequest:
    """the list query's parameters, checked on construction."""

    vehicle_id: str
    start: datetime | str | None = None
    end: datetime | str | None = None
    page: int = 1
    page_size: int = DEFAULT_PAGE_SIZE
    sort_by: str = "timestamp"
    sort_order: str = "asc"

    def __post_init__(self) -> None:
        if not isinstance(self.vehicle_id, str) or len(self.vehicle_id) < 1:
            raise ValueError("vehicle_id must not be empty")
        if not isinstance(self.page, int) or self.page < 1:
            raise ValueError("page must be >= 1")
        if not isinstance(self.page_size, int) or not 1 <= self.page_size <= MAX_PAGE_SIZE:
            raise ValueError(f"page_size must be between 1 and {MAX_PAGE_SIZE}")
        if self.sort_by not in SORT_FIELDS:
            raise ValueError(f"sort_by must be one of {', '.join(SORT_FIELDS)}")
        if self.sort_order not in SORT_ORDERS:
            raise ValueError(f"sort_order must be one of {', '.join(SORT_ORDERS)}")
        start, end = to_utc_naive(self.start), to_utc_naive(self.end)
        if start is not None and end is not None and start > end:
            raise ValueError("start_timestamp cannot be later than end_timestamp")

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.page_size


def filter_vehicle(df: DataFrame, vehicle_id: str) -> DataFrame:
    """F1."""
    return df.filter(F.col("vehicle_id") == F.lit(vehicle_id))


def filter_vehicles(df: DataFrame, vehicle_ids: list[str] | tuple[str, ...]) -> DataFrame:
    """vehicle IN list. Short lists stay an IN predicate (pushed into the
    scan); long ones become a semi join whose small side is the list itself,
    so its size is known before it is broadcast."""
    ids = list(dict.fromkeys(vehicle_ids))
    if len(ids) <= MAX_INLINE_IDS:
        return df.filter(F.col("vehicle_id").isin(ids))
    spark = df.sparkSession
    id_df = spark.createDataFrame([(i,) for i in ids], "vehicle_id string")
    if len(ids) <= MAX_BROADCAST_IDS:
        id_df = F.broadcast(id_df)
    return df.join(id_df, "vehicle_id", "left_semi")


def filter_time_range(
    df: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    ts_col: str = "timestamp",
    date_col: str | None = None,
) -> DataFrame:
    """inclusive range, each end optional.

    When the relation is the stored table, pass ``date_col="observed_date"``:
    the matching date predicate prunes partitions, which Catalyst cannot
    derive from a timestamp predicate on its own.
    """
    start_v, end_v = to_utc_naive(start), to_utc_naive(end)
    if start_v is not None:
        df = df.filter(F.col(ts_col) >= timestamp_literal(start_v))
        if date_col:
            df = df.filter(F.col(date_col) >= _date_literal(start_v.date()))
    if end_v is not None:
        df = df.filter(F.col(ts_col) <= timestamp_literal(end_v))
        if date_col:
            df = df.filter(F.col(date_col) <= _date_literal(end_v.date()))
    return df


def sort_columns(sort_by: str = "timestamp", sort_order: str = "asc") -> list[Column]:
    """O1: NULLs last when ascending and first when descending (PostgreSQL's
    default, the reverse of Spark's), then ``id`` ascending as tie-break."""
    if sort_by not in SORT_FIELDS or sort_order not in SORT_ORDERS:
        raise ValueError(f"unsupported sort {sort_by} {sort_order}")
    c = F.col(sort_by)
    first = c.desc_nulls_first() if sort_order == "desc" else c.asc_nulls_last()
    keys = [first]
    if sort_by != "id":
        keys.append(F.col("id").asc())
    return keys


def filtered(df: DataFrame, req: PageRequest, date_col: str | None = None) -> DataFrame:
    return filter_time_range(filter_vehicle(df, req.vehicle_id), req.start, req.end, date_col=date_col)


def page_items(df: DataFrame, req: PageRequest, date_col: str | None = None, with_position: bool = False) -> DataFrame:
    """O2: one page. Planned as ``TakeOrderedAndProject(limit=offset+size,
    offset=offset)``: each task keeps only offset+size rows, so no full sort.
    Deep pages cost more (see ``page_deep``, and the keyset form ``page_after``)."""
    keys = sort_columns(req.sort_by, req.sort_order)
    items = filtered(df, req, date_col).orderBy(*keys).offset(req.offset).limit(req.page_size)
    if with_position:
        # The page is at most MAX_PAGE_SIZE rows; numbering it needs no shuffle of the table.
        items = items.withColumn(
            "position", (F.row_number().over(Window.orderBy(*keys)) + F.lit(req.offset)).cast("long")
        )
    return items


def page_meta(df: DataFrame, req: PageRequest, date_col: str | None = None) -> DataFrame:
    """``page, page_size, total, pages`` with pages = ceil(total/size), 0 when empty."""
    total = filtered(df, req, date_col).agg(F.count(F.lit(1)).alias("total"))
    size = F.lit(req.page_size)
    return total.select(
        F.lit(req.page).alias("page"),
        size.alias("page_size"),
        "total",
        F.expr(f"(total + {req.page_size} - 1) div {req.page_size}").alias("pages"),
    )


def page(df: DataFrame, req: PageRequest, date_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The list endpoint: (items, meta). Past-the-end pages are empty with the right total."""
    return page_items(df, req, date_col), page_meta(df, req, date_col)


def page_after(
    df: DataFrame,
    req: PageRequest,
    after_value,
    after_id: int,
    date_col: str | None = None,
) -> DataFrame:
    """H8 keyset form of O2: rows strictly after ``(after_value, after_id)`` in
    the sort order, first ``page_size`` of them. Cost does not grow with depth."""
    keys = sort_columns(req.sort_by, req.sort_order)
    c, idc = F.col(req.sort_by), F.col("id")
    if req.sort_by == "id":
        cond = idc > F.lit(after_id)
    elif req.sort_order == "asc":  # NULLs last
        if after_value is None:
            cond = c.isNull() & (idc > F.lit(after_id))
        else:
            v = F.lit(after_value)
            cond = c.isNull() | (c > v) | ((c == v) & (idc > F.lit(after_id)))
    else:  # desc, NULLs first
        if after_value is None:
            cond = c.isNotNull() | (idc > F.lit(after_id))
        else:
            v = F.lit(after_value)
            cond = c.isNotNull() & ((c < v) | ((c == v) & (idc > F.lit(after_id))))
    return filtered(df, req, date_col).filter(cond).orderBy(*keys).limit(req.page_size)


def count_in_range(df: DataFrame, vehicle_id: str, start=None, end=None, date_col: str | None = None) -> DataFrame:
    """A1."""
    rel = filter_time_range(filter_vehicle(df, vehicle_id), start, end, date_col=date_col)
    return rel.agg(F.count(F.lit(1)).alias("total"))


def point_lookup(df: DataFrame, row_id: int) -> DataFrame:
    """Zero rows means not found. Parquet min/max on ``id`` skips row
    groups, since ids are assigned in clustered order per load."""
    return df.filter(F.col("id") == F.lit(row_id))


def chart_series(df: DataFrame, fields: tuple[str, ...] = ("speed", "odometer", "soc", "elevation")) -> DataFrame:
    """One ``(timestamp, field, value)`` row per numeric, non-NULL value,
    for every chartable field at once (the UI picks one field of one page)."""
    return (
        df.unpivot(["id", "vehicle_id", "timestamp"], list(fields), "field", "value")
        .filter(F.col("value").isNotNull())
    )


# Ranges that a round of page_deep cuts a sort key into, and rows that it leaves to be sorted.
DEEP_RANGES = 64
DEEP_ROWS = 100_000


def _bounds(rows: DataFrame, column: str) -> list:
    """At most ``DEEP_RANGES`` sorted values of a column, its largest among them (of text: of its first values)."""
    if dict(rows.dtypes)[column] == "string":
        first = rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(DEEP_RANGES)
        return [r[0] for r in first.collect()]
    key = _number_of(rows, column)
    cuts = [i / DEEP_RANGES for i in range(1, DEEP_RANGES)]
    found = rows.agg(F.percentile_approx(key, cuts, 10_000).alias("cuts"), F.max(key).alias("last")).first()
    inner = sorted({b for b in found["cuts"] or () if b == b and b != found["last"]})
    return inner if found["last"] is None else [*inner, found["last"]]  # NaN, the largest of all, comes last


def _number_of(rows: DataFrame, column: str) -> Column:
    # Micros, not datetimes: these would pass through the driver's local zone.
    return F.unix_micros(column) if dict(rows.dtypes)[column].startswith("timestamp") else F.col(column)


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, found by halves."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    above = F.lit(middle + 1) + _range_of(key, bounds[middle + 1:])
    return F.when(key >= F.lit(bounds[middle]), above).otherwise(_range_of(key, bounds[:middle]))


def _in_ranges(rows: DataFrame, column: str, bounds: list, places: list[int | None]) -> Column:
    """Neighbouring ranges as a filter on the column itself, which a scan can use; ``None`` is that of the NULLs."""
    c, numbers = F.col(column), [p for p in places if p is not None]
    of_time = dict(rows.dtypes)[column].startswith("timestamp")

    def below(bound) -> Column:
        if bound != bound:
            return ~F.isnan(c)
        return c < (F.timestamp_micros(F.lit(bound)) if of_time else F.lit(bound))

    wanted = c.isNull() if None in places else F.lit(False)
    if numbers:
        inside = c.isNotNull()
        if min(numbers) > 0:
            inside = inside & ~below(bounds[min(numbers) - 1])
        if max(numbers) < len(bounds):
            inside = inside & below(bounds[max(numbers)])
        wanted = wanted | inside
    return wanted


def _deep_parts(
    rows: DataFrame, columns: tuple[str, ...], descending: bool, offset: int, size: int, most_rows: int
) -> list[tuple[DataFrame, int, int]]:
    """``(rows, offset, size)``: together the places ``offset`` to ``offset + size`` of ``rows`` by ``columns``, the first
    of them descending or not, the others ascending; each with ``most_rows`` rows or fewer, or rows equal in all columns."""
    column = columns[0]
    bounds = _bounds(rows, column)
    key = _number_of(rows, column)
    counted = rows.groupBy(F.when(key.isNotNull(), _range_of(key, bounds)).alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).eqNullSafe(F.max(key)).alias("one")).collect()
    # NULLs come after all ranges, and so first when these are read backwards.
    ranges = sorted(counted, key=lambda r: len(bounds) + 1 if r["place"] is None else r["place"], reverse=descending)
    held, passed = [], 0  # the ranges that hold places of the page, with the rows ahead of them
    for r in ranges:
        if offset < passed + r["n"] and passed < offset + size:
            held.append((r, passed))
        passed += r["n"]
    if not held:
        return []
    if sum(r["n"] for r, _ in held) <= most_rows:
        return [(rows.filter(_in_ranges(rows, column, bounds, [r["place"] for r, _ in held])), offset - held[0][1], size)]
    parts = []
    for r, ahead in held:
        own = rows.filter(_in_ranges(rows, column, bounds, [r["place"]]))
        start = max(0, offset - ahead)
        take = min(offset + size, ahead + r["n"]) - ahead - start
        if r["n"] <= most_rows or (r["one"] and len(columns) == 1):
            parts.append((own, start, take))
        elif r["one"]:
            parts += _deep_parts(own, columns[1:], False, start, take, most_rows)
        else:
            parts += _deep_parts(own, columns, descending, start, take, most_rows)
    return parts


def page_deep(df: DataFrame, req: PageRequest, date_col: str | None = None, most_rows: int = DEEP_ROWS) -> DataFrame:
    """O2 for pages far behind: the rows of ``page_items``, with few rows sorted.

    Quantiles cut the sort key into ranges, counts per range tell which one holds
    the page, and the next round looks at that one alone, until ``most_rows`` are
    left to be sorted; rows of one value (ties, NULLs) are cut by ``id``. A page
    over the edge of two ranges takes a part of each. A round is two aggregations
    with partial sums in the map tasks; ``DEEP_RANGES`` bounds and counts reach
    the driver, and the range is a filter that the scan can use. Rows that agree
    in key and id too are sorted together. Pages near the front are ``page_items``."""
    if req.offset + req.page_size <= most_rows:
        return page_items(df, req, date_col)
    keys, rows = sort_columns(req.sort_by, req.sort_order), filtered(df, req, date_col)
    columns = tuple(dict.fromkeys((req.sort_by, "id")))
    parts = [
        part.orderBy(*keys).offset(start).limit(take)
        for part, start, take in _deep_parts(rows, columns, req.sort_order == "desc", req.offset, req.page_size, most_rows)
    ]
    if not parts:
        return rows.limit(0)
    return reduce(DataFrame.unionByName, parts).orderBy(*keys)

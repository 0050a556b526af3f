"""Registered queries: the text-cell functions (P1–P7) and row validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.catalog.derived import (
    EXPECTED_CTE,
    ISO_TEXTS_SQL,
    PATTERN_TEXTS_SQL,
    RAW_RECORDS_CTE,
    SHIFT_TEXTS_SQL,
    TOKEN_CELLS_CTE,
    iso_texts,
    pattern_texts,
    raw_records,
    shift_texts,
    token_cells,
)
from fleetlake.catalog.registry import register, with_ctes
from fleetlake.functions import (
    is_null_token,
    normalise_shift_state,
    nullable_float,
    nullable_float_error,
    nullable_string,
    parse_iso_timestamp,
    parse_with_patterns,
    required_float,
    required_float_reason,
)
from fleetlake.operators import validate as v
from fleetlake.sources.tables import driver_table

_TOKEN_KS = "(0, 1, 2, 3, 4, 8)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "events")


@register(
    "null_token_flag",
    with_ctes(TOKEN_CELLS_CTE) + f"SELECT id, cell, k IN {_TOKEN_KS} AS is_null_token FROM cells",
)
def null_token_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    cells = token_cells(_events(spark, sf_dir))
    return cells.select("id", "cell", is_null_token("cell").alias("is_null_token"))


@register(
    "nullable_float",
    with_ctes(TOKEN_CELLS_CTE)
    + """SELECT id, cell, CASE WHEN k IN (5, 7) THEN num END AS value, k IN (6, 9) AS is_error FROM cells""",
)
def nullable_float_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens → NULL, numbers (also padded) → double, other text → error."""
    cells = token_cells(_events(spark, sf_dir))
    return cells.select(
        "id", "cell", nullable_float("cell").alias("value"), nullable_float_error("cell").alias("is_error")
    )


@register(
    "nullable_string",
    with_ctes(TOKEN_CELLS_CTE)
    + f"""SELECT id, cell, CASE WHEN k IN {_TOKEN_KS} THEN NULL WHEN k = 5 THEN printf('%.2f', value)
       ELSE cell END AS value FROM cells""",
)
def nullable_string_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    cells = token_cells(_events(spark, sf_dir))
    return cells.select("id", "cell", nullable_string("cell").alias("value"))


@register(
    "required_float",
    with_ctes(TOKEN_CELLS_CTE)
    + """SELECT id, cell, CASE WHEN k IN (5, 7) THEN num END AS value,
       CASE WHEN k IN (2, 3, 8) THEN 'odometer_empty' WHEN k IN (5, 7) THEN NULL
            ELSE 'odometer_not_numeric' END AS reason
FROM cells""",
)
def required_float_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank → ``_empty``; ``NULL`` text is not numeric here."""
    cells = token_cells(_events(spark, sf_dir))
    return cells.select(
        "id",
        "cell",
        required_float("cell").alias("value"),
        required_float_reason("cell", "odometer").alias("reason"),
    )


@register("parse_timestamp", ISO_TEXTS_SQL)
def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: ISO text with Z, offsets, seconds only, date only, basic format;
    bare times are rejected (Spark alone would read a bare time as today)."""
    texts = iso_texts(_events(spark, sf_dir))
    return texts.select("id", "raw", parse_iso_timestamp("raw").alias("parsed"))


@register("parse_timestamp_patterns", PATTERN_TEXTS_SQL)
def parse_timestamp_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming path's two patterns, first match wins."""
    texts = pattern_texts(_events(spark, sf_dir))
    return texts.select("id", "raw", parse_with_patterns("raw").alias("parsed"))


@register("normalise_shift_state", SHIFT_TEXTS_SQL)
def normalise_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    texts = shift_texts(_events(spark, sf_dir))
    return texts.select("id", "raw", normalise_shift_state("raw").alias("shift_state"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.validate(raw_records(_events(spark, sf_dir)).drop("file_date"))


@register(
    "validate_rows",
    with_ctes(RAW_RECORDS_CTE, EXPECTED_CTE)
    + """SELECT id, vehicle_id, "timestamp", speed, odometer, soc, elevation, shift_state, reasons,
       reasons = '' AS is_valid
FROM expected""",
)
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """typed values, every reject reason, validity (never NULL)."""
    checked = _validated(spark, sf_dir)
    return checked.select(
        "id", "vehicle_id", "timestamp", "speed", "odometer", "soc", "elevation", "shift_state",
        F.array_join("reject_reasons", ";").alias("reasons"),
        v.is_valid().alias("is_valid"),
    )


@register(
    "validity_counts",
    with_ctes(RAW_RECORDS_CTE, EXPECTED_CTE)
    + """SELECT count(*) AS rows_read, count(*) FILTER (WHERE reasons = '') AS rows_valid,
       count(*) FILTER (WHERE reasons <> '') AS rows_rejected
FROM expected""",
)
def validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """valid and rejected counts in one aggregate."""
    return v.validity_counts(_validated(spark, sf_dir))


@register(
    "rejects",
    with_ctes(RAW_RECORDS_CTE, EXPECTED_CTE)
    + """SELECT id, vehicle_id, raw_timestamp, raw_speed, raw_odometer, raw_soc, raw_elevation, raw_shift_state,
       reasons
FROM expected WHERE reasons <> ''""",
)
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: rejected rows with raw text and reasons."""
    checked = _validated(spark, sf_dir)
    return v.rejected_rows(checked).select(
        "id",
        "vehicle_id",
        "raw_timestamp", "raw_speed", "raw_odometer", "raw_soc", "raw_elevation", "raw_shift_state",
        F.array_join("reject_reasons", ";").alias("reasons"),
    )

"""Raw text derived from the driver's ``events`` table, in Spark and in SQL.

The parsing queries need text cells. They are built from every ``events``
row by fixed rules (selected by ``event_id`` modulo a small number, never
used to filter), so the work grows with the table and an SQL engine can
state the expected answer from the same rules without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _ts() -> Column:
    return F.col("ts").cast("timestamp")


def _fmt(c: Column, pattern: str) -> Column:
    return F.date_format(c, pattern)


def _f2(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _vehicle() -> Column:
    return F.concat(F.lit("veh-"), (F.col("user_id") % F.lit(10)).cast("string"))


# ---------------------------------------------------------------- cells

def token_cells(events: DataFrame) -> DataFrame:
    """``id, cell``: null tokens, padded numbers, words, NULL, ``1d``-style text."""
    k = F.col("event_id") % F.lit(10)
    v = _f2(F.col("value"))
    cell = (
        F.when(k == 0, F.lit("NULL"))
        .when(k == 1, F.lit(" n/a "))
        .when(k == 2, F.lit(""))
        .when(k == 3, F.lit("   "))
        .when(k == 4, F.lit("None"))
        .when(k == 5, F.concat(F.lit(" "), v, F.lit(" ")))
        .when(k == 6, F.lit("abc"))
        .when(k == 7, v)
        .when(k == 8, F.lit(None).cast("string"))
        .otherwise(F.concat(v, F.lit("d")))
    )
    return events.select(F.col("event_id").alias("id"), cell.alias("cell"), "value")


TOKEN_CELLS_CTE = """cells AS (
    SELECT event_id AS id, event_id % 10 AS k, value, CAST(printf('%.2f', value) AS DOUBLE) AS num,
           CASE event_id % 10 WHEN 0 THEN 'NULL' WHEN 1 THEN ' n/a ' WHEN 2 THEN '' WHEN 3 THEN '   '
                WHEN 4 THEN 'None' WHEN 5 THEN ' ' || printf('%.2f', value) || ' ' WHEN 6 THEN 'abc'
                WHEN 7 THEN printf('%.2f', value) WHEN 8 THEN NULL ELSE printf('%.2f', value) || 'd' END AS cell
    FROM events
)"""


# ------------------------------------------------------------ timestamps

def iso_texts(events: DataFrame) -> DataFrame:
    """``id, raw, ts``: eight ISO shapes, two of them outside the contract."""
    k = F.col("event_id") % F.lit(8)
    ts = _ts()
    raw = (
        F.when(k == 0, _fmt(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(k == 1, F.concat(_fmt(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(k == 2, F.concat(_fmt(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
        .when(k == 3, F.concat(_fmt(ts - F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-05:30")))
        .when(k == 4, _fmt(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 5, _fmt(ts, "yyyy-MM-dd"))
        .when(k == 6, _fmt(ts, "yyyyMMdd'T'HHmmss"))
        .otherwise(_fmt(ts, "HH:mm:ss"))
    )
    return events.select(F.col("event_id").alias("id"), raw.alias("raw"))


ISO_TEXTS_SQL = """SELECT event_id AS id,
       CASE event_id % 8
            WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
            WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
            WHEN 2 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00'
            WHEN 3 THEN strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '-05:30'
            WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            WHEN 5 THEN strftime(ts, '%Y-%m-%d')
            WHEN 6 THEN strftime(ts, '%Y%m%dT%H%M%S')
            ELSE strftime(ts, '%H:%M:%S') END AS raw,
       CASE event_id % 8
            WHEN 4 THEN date_trunc('second', ts)
            WHEN 5 THEN date_trunc('day', ts)
            WHEN 6 THEN date_trunc('second', ts)
            WHEN 7 THEN NULL
            ELSE ts END AS parsed
FROM events"""


def pattern_texts(events: DataFrame) -> DataFrame:
    """``id, raw`` for the two-pattern parser: millis naive, millis with offset,
    no fraction with ``Z`` and six fraction digits (the last two fail)."""
    k = F.col("event_id") % F.lit(4)
    ts = _ts()
    raw = (
        F.when(k == 0, _fmt(ts, "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(k == 1, F.concat(_fmt(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00")))
        .when(k == 2, F.concat(_fmt(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .otherwise(_fmt(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    return events.select(F.col("event_id").alias("id"), raw.alias("raw"))


PATTERN_TEXTS_SQL = """SELECT event_id AS id,
       CASE event_id % 4
            WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g')
            WHEN 1 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || '+02:00'
            WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
            ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS raw,
       CASE WHEN event_id % 4 IN (0, 1) THEN date_trunc('millisecond', ts) END AS parsed
FROM events"""


# ------------------------------------------------------------ shift state

def shift_texts(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % F.lit(5)
    raw = (
        F.when(k == 0, F.lit(" d "))
        .when(k == 1, F.lit(""))
        .when(k == 2, F.lit("  "))
        .when(k == 3, F.lower(F.substring("event_type", 1, 1)))
        .otherwise(F.upper(F.substring("event_type", 1, 2)))
    )
    return events.select(F.col("event_id").alias("id"), raw.alias("raw"))


SHIFT_TEXTS_SQL = """SELECT event_id AS id,
       CASE event_id % 5 WHEN 0 THEN ' d ' WHEN 1 THEN '' WHEN 2 THEN '  '
            WHEN 3 THEN lower(substr(event_type, 1, 1)) ELSE upper(substr(event_type, 1, 2)) END AS raw,
       CASE event_id % 5 WHEN 0 THEN 'D' WHEN 1 THEN NULL WHEN 2 THEN NULL
            WHEN 3 THEN upper(substr(event_type, 1, 1)) ELSE upper(substr(event_type, 1, 2)) END AS shift_state
FROM events"""


# ------------------------------------------------------- raw CSV records

# Vehicles whose text carries no defect (their files pass the whole-file rule).
CLEAN_VEHICLES = (4, 5)


def raw_records(events: DataFrame) -> DataFrame:
    """Contract records as text: ``id, vehicle_id, file_date`` and the six
    CSV columns. Mostly valid rows; fixed shares carry each kind of defect,
    except for the clean vehicles (4, 5), whose soc is also capped at 100."""
    clean = (F.col("user_id") % F.lit(10)).isin(list(CLEAN_VEHICLES))
    k = F.when(clean, F.lit(-1)).otherwise(F.col("event_id") % F.lit(20))
    ts = _ts()
    err = F.col("event_type") == F.lit("error")
    v = _f2(F.col("value"))
    soc = _f2(F.when(clean, F.least(F.col("value"), F.lit(100.0))).otherwise(F.col("value")))
    odo = F.format_string("%.1f", F.col("event_id").cast("double") / F.lit(10.0))
    raw_ts = (
        F.when(k == 3, F.concat(_fmt(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(k == 7, F.concat(_fmt(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
        .when(k == 11, F.lit("not-a-time"))
        .when(k == 15, F.lit(""))
        .otherwise(_fmt(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    raw_speed = (
        F.when(err, F.lit("NULL"))
        .when(k == 5, F.lit(" n/a "))
        .when(k == 9, F.lit("fast"))
        .when(k == 13, F.concat(F.lit(" "), v, F.lit(" ")))
        .otherwise(v)
    )
    raw_odo = F.when(k == 17, F.lit("")).when(k == 19, F.concat(F.lit("-"), odo)).otherwise(odo)
    raw_shift = (
        F.when(err, F.lit("NULL"))
        .when(k == 1, F.lit("pu"))
        .when(F.col("event_type") == F.lit("view"), F.lit(" v "))
        .otherwise(F.upper(F.substring("event_type", 1, 1)))
    )
    return events.select(
        F.col("event_id").alias("id"),
        _vehicle().alias("vehicle_id"),
        _fmt(ts, "yyyy-MM-dd").alias("file_date"),
        raw_ts.alias("timestamp"),
        raw_speed.alias("speed"),
        raw_odo.alias("odometer"),
        soc.alias("soc"),
        F.regexp_extract("props", "[0-9]+", 0).alias("elevation"),
        raw_shift.alias("shift_state"),
    )


RAW_RECORDS_CTE = """base AS (
    SELECT *, user_id % 10 IN (4, 5) AS clean,
           CASE WHEN user_id % 10 IN (4, 5) THEN -1 ELSE event_id % 20 END AS kk,
           CASE WHEN user_id % 10 IN (4, 5) THEN least(value, 100.0) ELSE value END AS soc_value
    FROM events
), raw AS (
    SELECT event_id AS id,
           'veh-' || CAST(user_id % 10 AS VARCHAR) AS vehicle_id,
           strftime(ts, '%Y-%m-%d') AS file_date,
           kk AS k,
           event_type = 'error' AS err,
           ts, value, soc_value, event_type, event_id,
           CASE kk
                WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
                WHEN 7 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00'
                WHEN 11 THEN 'not-a-time'
                WHEN 15 THEN ''
                ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS raw_timestamp,
           CASE WHEN event_type = 'error' THEN 'NULL'
                WHEN kk = 5 THEN ' n/a '
                WHEN kk = 9 THEN 'fast'
                WHEN kk = 13 THEN ' ' || printf('%.2f', value) || ' '
                ELSE printf('%.2f', value) END AS raw_speed,
           CASE kk WHEN 17 THEN '' WHEN 19 THEN '-' || printf('%.1f', event_id / 10.0)
                ELSE printf('%.1f', event_id / 10.0) END AS raw_odometer,
           printf('%.2f', soc_value) AS raw_soc,
           regexp_extract(props, '[0-9]+', 0) AS raw_elevation,
           CASE WHEN event_type = 'error' THEN 'NULL'
                WHEN kk = 1 THEN 'pu'
                WHEN event_type = 'view' THEN ' v '
                ELSE upper(substr(event_type, 1, 1)) END AS raw_shift_state
    FROM base
)"""

# Expected typed values and reasons, stated from the rules above.
EXPECTED_CTE = """expected AS (
    SELECT id, vehicle_id, file_date, raw_timestamp, raw_speed, raw_odometer, raw_soc, raw_elevation, raw_shift_state,
           CASE WHEN k IN (11, 15) THEN NULL ELSE ts END AS "timestamp",
           CASE WHEN err OR k IN (5, 9) THEN NULL ELSE CAST(printf('%.2f', value) AS DOUBLE) END AS speed,
           CASE WHEN k = 17 THEN NULL
                WHEN k = 19 THEN -CAST(printf('%.1f', event_id / 10.0) AS DOUBLE)
                ELSE CAST(printf('%.1f', event_id / 10.0) AS DOUBLE) END AS odometer,
           CAST(printf('%.2f', soc_value) AS DOUBLE) AS soc,
           TRY_CAST(regexp_extract(raw_elevation, '[0-9]+', 0) AS DOUBLE) AS elevation,
           CASE WHEN err THEN NULL WHEN k = 1 THEN 'PU' WHEN event_type = 'view' THEN 'V'
                ELSE upper(substr(event_type, 1, 1)) END AS shift_state,
           concat_ws(';',
                CASE WHEN k = 15 THEN 'timestamp_empty' END,
                CASE WHEN k = 11 THEN 'timestamp_invalid' END,
                CASE WHEN k = 9 AND NOT err THEN 'speed_not_numeric' END,
                CASE WHEN k = 17 THEN 'odometer_empty' END,
                CASE WHEN k = 19 THEN 'odometer_negative' END,
                CASE WHEN CAST(printf('%.2f', soc_value) AS DOUBLE) > 100 THEN 'soc_out_of_range' END,
                CASE WHEN k = 1 AND NOT err THEN 'shift_state_too_long' END) AS reasons
    FROM raw
)"""

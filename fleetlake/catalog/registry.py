"""Registry plumbing and the shared pieces of every oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, TimestampType

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Fixed parameters of the registered queries.
VEHICLE = "veh-3"
RANGE_START = "2024-01-08 06:00:00"
RANGE_END = "2024-01-21 18:30:00"
DASHBOARD_VEHICLES = ("veh-1", "veh-4", "veh-7")
LOOKUP_ID = 4242
REFRESH_FROM = "2024-01-20"
DECIMALS = 6

# The events → telemetry mapping of sources.tables.telemetry_from_events, as SQL.
TELEMETRY_CTE = """telemetry AS (
    SELECT event_id AS id,
           'veh-' || CAST(user_id % 10 AS VARCHAR) AS vehicle_id,
           ts AS "timestamp",
           CASE WHEN event_type = 'error' THEN NULL ELSE value END AS speed,
           CAST(event_id AS DOUBLE) / 10.0 AS odometer,
           value AS soc,
           TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS elevation,
           upper(substr(event_type, 1, 1)) AS shift_state
    FROM events
)"""

STAGING_CTE = """stg_vehicle_data AS (
    SELECT id AS vehicle_data_id, vehicle_id, "timestamp" AS observed_at, speed, odometer,
           soc AS state_of_charge_pct, elevation, upper(nullif(trim(shift_state), '')) AS shift_state
    FROM telemetry
)"""

MART_CTE = f"""fct_vehicle_hourly AS (
    SELECT vehicle_id,
           date_trunc('hour', observed_at) AS observed_hour,
           count(*) AS observation_count,
           avg(speed) AS average_speed,
           min(state_of_charge_pct) AS minimum_state_of_charge_pct,
           max(state_of_charge_pct) AS maximum_state_of_charge_pct,
           max(odometer) - min(odometer) AS distance_travelled
    FROM stg_vehicle_data
    GROUP BY 1, 2
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def r(expr: str) -> str:
    """Round a double expression in an oracle the way ``for_oracle`` does."""
    return f"round({expr}, {DECIMALS})"


def for_oracle(df: DataFrame) -> DataFrame:
    """Make a result comparable with the SQL engine: UTC timestamps as
    timestamp-without-zone (exact, the session zone is UTC) and doubles
    rounded to 6 places (summation order differs between engines)."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, DoubleType):
            c = F.round(c, DECIMALS)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return for_oracle(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco

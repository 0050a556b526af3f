"""Registered queries: declarative data tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.catalog.registry import MART_CTE, STAGING_CTE, TELEMETRY_CTE, register, with_ctes
from fleetlake.operators import marts, quality
from fleetlake.plans.build import MART_CHECKS, SOURCE_CHECKS, STAGING_CHECKS, build_with_tests
from fleetlake.session import scratch_path
from fleetlake.sources.tables import driver_telemetry

# The driver's telemetry made dirty: some ids, vehicles and times are missing, and
# every 97th row comes twice.
DIRTY_CTE = TELEMETRY_CTE.replace("telemetry AS", "clean AS", 1) + """, telemetry AS (
    SELECT CASE WHEN id % 89 <> 0 THEN id END AS id, CASE WHEN id % 101 <> 0 THEN vehicle_id END AS vehicle_id,
           CASE WHEN id % 103 <> 0 THEN "timestamp" END AS "timestamp", speed, odometer, soc, elevation, shift_state
    FROM (SELECT * FROM clean UNION ALL SELECT * FROM clean WHERE id % 97 = 0)
)"""
# The rows of the driver's telemetry that keep every rule.
CLEAN_CTE = TELEMETRY_CTE.replace("telemetry AS", "every_row AS", 1) + """, telemetry AS (
    SELECT * FROM every_row WHERE soc BETWEEN 0 AND 100
)"""
_ALL_CTES = with_ctes(DIRTY_CTE, STAGING_CTE, MART_CTE)
_RELATION = {"vehicle_data": "telemetry", "stg_vehicle_data": "stg_vehicle_data", "fct_vehicle_hourly": "fct_vehicle_hourly"}


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = driver_telemetry(spark, sf_dir)
    rows = clean.unionByName(clean.filter(F.col("id") % 97 == 0))
    gaps = {"id": 89, "vehicle_id": 101, "timestamp": 103}
    return rows.select(*[F.when(F.col("id") % gaps[c] != 0, F.col(c)).alias(c) if c in gaps else c for c in rows.columns])


def _models(spark: SparkSession, sf_dir: str, dirty: bool = True) -> dict[str, DataFrame]:
    source = _dirty(spark, sf_dir) if dirty else driver_telemetry(spark, sf_dir)
    staging = marts.stg_vehicle_data(source)
    return {"vehicle_data": source, "stg_vehicle_data": staging, "fct_vehicle_hourly": marts.fct_vehicle_hourly(staging)}


def _not_null_sql() -> str:
    parts = []
    for c in SOURCE_CHECKS + STAGING_CHECKS + MART_CHECKS:
        if c.kind == "not_null":
            col = c.columns[0]
            parts.append(
                f"""SELECT '{c.model}' AS model, '{col}' AS column_name, count(*) FILTER (WHERE "{col}" IS NULL) AS failures
FROM {_RELATION[c.model]}"""
            )
    return _ALL_CTES + "\nUNION ALL\n".join(parts)


@register("dq_not_null", _not_null_sql())
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL count of every declared not_null column, per model."""
    models = _models(spark, sf_dir)
    out = None
    for name in ("vehicle_data", "stg_vehicle_data", "fct_vehicle_hourly"):
        checks = [c for c in SOURCE_CHECKS + STAGING_CHECKS + MART_CHECKS if c.model == name and c.kind == "not_null"]
        counts = quality.check_counts(models[name], checks)
        names = F.create_map(*[x for i, c in enumerate(checks) for x in (F.lit(i), F.lit(c.columns[0]))])
        part = counts.select(F.lit(name).alias("model"), names[F.col("check_index")].alias("column_name"), "failures")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "dq_unique",
    with_ctes(DIRTY_CTE, STAGING_CTE)
    + """SELECT vehicle_data_id, count(*) AS n_records FROM stg_vehicle_data
WHERE vehicle_data_id IS NOT NULL GROUP BY vehicle_data_id HAVING count(*) > 1""",
)
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicated ``vehicle_data_id`` values."""
    return quality.unique(_models(spark, sf_dir)["stg_vehicle_data"], "vehicle_data_id")


@register(
    "dq_accepted_range",
    with_ctes(TELEMETRY_CTE, STAGING_CTE)
    + "SELECT * FROM stg_vehicle_data WHERE state_of_charge_pct < 0 OR state_of_charge_pct > 100",
)
def dq_accepted_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging rows with soc outside 0..100 (the driver data has some)."""
    return quality.accepted_range(_models(spark, sf_dir, dirty=False)["stg_vehicle_data"], "state_of_charge_pct", 0, 100)


@register(
    "dq_unique_combination",
    _ALL_CTES
    + """SELECT vehicle_id, observed_at, count(*) AS n_records FROM stg_vehicle_data
GROUP BY vehicle_id, observed_at HAVING count(*) > 1""",
)
def dq_unique_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles with more than one observation at one time."""
    return quality.unique_combination(_models(spark, sf_dir)["stg_vehicle_data"], ["vehicle_id", "observed_at"])


def _summary_sql(telemetry: str) -> str:
    """The same build as SQL: counts per check, then pass/fail/skipped."""
    checks = SOURCE_CHECKS + STAGING_CHECKS + MART_CHECKS
    parts = []
    for c in checks:
        rel, col = _RELATION[c.model], c.columns[0]
        if c.kind == "not_null":
            q = f"""SELECT count(*) FILTER (WHERE "{col}" IS NULL) FROM {rel}"""
        elif c.kind == "unique":
            q = f"""SELECT count(*) FROM (SELECT "{col}" FROM {rel} WHERE "{col}" IS NOT NULL GROUP BY 1 HAVING count(*) > 1) u"""
        elif c.kind == "accepted_range":
            q = f"""SELECT count(*) FROM {rel} WHERE "{col}" < {c.min_value} OR "{col}" > {c.max_value}"""
        else:
            cols = ", ".join(f'"{x}"' for x in c.columns)
            q = f"""SELECT count(*) FROM (SELECT {cols} FROM {rel} GROUP BY {cols} HAVING count(*) > 1) u"""
        parts.append((c, q))
    n_src, n_stg = len(SOURCE_CHECKS), len(STAGING_CHECKS)
    lines = []
    step = 0
    for i, (c, q) in enumerate(parts):
        if i == n_src:
            step += 1
            lines.append(f"SELECT {step} AS step, 'stg_vehicle_data' AS model, 'build' AS check_name, NULL AS column_name, "
                         "NULL AS failures, CASE WHEN (SELECT src_fail FROM gate) THEN 'skipped' ELSE 'success' END AS status")
        if i == n_src + n_stg:
            step += 1
            lines.append(f"SELECT {step} AS step, 'fct_vehicle_hourly' AS model, 'build' AS check_name, "
                         "NULL AS column_name, NULL AS failures, "
                         "CASE WHEN (SELECT src_fail OR stg_fail FROM gate) THEN 'skipped' ELSE 'success' END AS status")
        step += 1
        stage = "FALSE" if i < n_src else ("(SELECT src_fail FROM gate)" if i < n_src + n_stg else "(SELECT src_fail OR stg_fail FROM gate)")
        lines.append(
            f"SELECT {step} AS step, '{c.model}' AS model, '{c.kind}' AS check_name, "
            f"'{','.join(c.columns)}' AS column_name, "
            f"CASE WHEN {stage} THEN NULL ELSE ({q}) END AS failures, "
            f"CASE WHEN {stage} THEN 'skipped' WHEN ({q}) = 0 THEN 'pass' ELSE 'fail' END AS status"
        )
    src_q = " + ".join(f"({q})" for c, q in parts[:n_src])
    stg_q = " + ".join(f"({q})" for c, q in parts[n_src:n_src + n_stg])
    gate = f"gate AS (SELECT ({src_q}) > 0 AS src_fail, ({stg_q}) > 0 AS stg_fail)"
    return with_ctes(telemetry, STAGING_CTE, MART_CTE, gate) + "\nUNION ALL\n".join(lines)


@register("dq_summary", _summary_sql(TELEMETRY_CTE))
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build with tests; the staging range test fails on the driver data,
    so the mart and its tests are skipped."""
    return build_with_tests(spark, driver_telemetry(spark, sf_dir))


@register("dq_summary_pass", _summary_sql(CLEAN_CTE))
def dq_summary_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build with tests on rows that keep every rule: the mart is written as a table and tested too."""
    clean = driver_telemetry(spark, sf_dir).filter(F.col("soc").between(0, 100))
    return build_with_tests(spark, clean, mart_path=scratch_path(spark, "mart-pass"))

"""The one ingest contract (F5–F10): typed columns plus reject reasons.

A raw record has ``source_file, row_number, vehicle_id`` and the six contract
columns as text (NULL when the cell is absent). ``validate`` adds the typed
values and ``reject_reasons array<string>``; a row is valid when that array
is empty, so validity is never NULL (a NULL soc is a reason, not a NULL test).
All of it is one projection: no shuffle, no Python.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.functions.timestamps import iso_to_timestamp
from fleetlake.functions.tokens import parse_number, strip
from fleetlake.schema import NULL_TOKENS, REQUIRED_COLUMNS, VEHICLE_ID_MAX_LENGTH
from fleetlake.session import ensure_conf, scratch_path

# The list of bad files is broadcast when its measured size is below this.
BAD_FILES_BROADCAST_BYTES = 64 * 1024 * 1024
_OBSERVATION_IDS = itertools.count()

_NUMERIC = ("speed", "odometer", "soc", "elevation")
TYPED_COLUMNS = ("vehicle_id", "timestamp", "speed", "odometer", "soc", "elevation", "shift_state")


def _reason(cond: Column, text: str) -> Column:
    return F.when(cond, F.lit(text))


def _number(text: Column) -> Column:
    return parse_number(text)


def _token(text: Column) -> Column:
    return text.isNull() | F.upper(text).isin(*NULL_TOKENS)


def _blank(text: Column) -> Column:
    return text.isNull() | (text == F.lit(""))


def validate(raw: DataFrame) -> DataFrame:
    """typed record + ``reject_reasons`` (+ the raw text as ``raw_*``).

    Three projections, each reading the previous one's columns: stripped
    text → per-cell facts (parsed number, blank, token) → typed values and
    reasons. Every regex and cast runs once per cell, and Catalyst keeps
    the steps apart because the facts are used several times.

    Reasons: ``missing_columns:<sorted list>``, ``encoding_invalid`` (the line is
    not valid UTF-8), ``record_too_long`` (its quoted line breaks take in too much), ``vehicle_id_empty``,
    ``vehicle_id_too_long``, ``timestamp_empty``, ``timestamp_invalid``,
    ``speed_not_numeric``, ``<odometer|soc|elevation>_empty``,
    ``<…>_not_numeric``, ``odometer_negative``, ``soc_out_of_range``,
    ``shift_state_too_long``. A column the header lacks is reported once,
    as missing, not again per row.
    """
    ensure_conf(raw.sparkSession)  # naive text is read as UTC
    keep = [c for c in raw.columns if c not in REQUIRED_COLUMNS + ("vehicle_id", "missing_columns", "bad_encoding", "too_long")]
    bad_encoding = F.col("bad_encoding") if "bad_encoding" in raw.columns else F.lit(False)
    too_long = F.col("too_long") if "too_long" in raw.columns else F.lit(False)
    missing = (
        F.col("missing_columns") if "missing_columns" in raw.columns else F.lit(None).cast("array<string>")
    )
    text = raw.select(
        *keep,
        "vehicle_id",
        missing.alias("_missing"),
        bad_encoding.alias("_bad_encoding"),
        too_long.alias("_too_long"),
        *[F.col(c).alias(f"raw_{c}") for c in REQUIRED_COLUMNS],
        *[strip(c).alias(f"_t_{c}") for c in REQUIRED_COLUMNS],
    )
    t = {c: F.col(f"_t_{c}") for c in REQUIRED_COLUMNS}
    facts = text.select(
        *keep,
        "vehicle_id",
        "_missing",
        "_bad_encoding",
        "_too_long",
        *[f"raw_{c}" for c in REQUIRED_COLUMNS],
        _blank(t["timestamp"]).alias("_ts_blank"),
        iso_to_timestamp(t["timestamp"]).alias("_ts"),
        _token(t["speed"]).alias("_speed_token"),
        *[_blank(t[c]).alias(f"_{c}_blank") for c in ("odometer", "soc", "elevation")],
        # One function over the numeric cells. As a higher-order function it also has this projection compiled on its
        # own, in small methods: fused with the parser it was one method too large for the JIT, which then only
        # interprets it.
        F.transform(F.array(*[t[c] for c in _NUMERIC]), _number).alias("_numbers"),
        F.when(~_token(t["shift_state"]), t["shift_state"]).alias("_shift"),
    )
    vid, miss = F.col("vehicle_id"), F.col("_missing")
    number = {c: F.col("_numbers")[i] for i, c in enumerate(_NUMERIC)}

    def present(name: str) -> Column:
        return F.coalesce(~F.array_contains(miss, F.lit(name)), F.lit(True))

    def required(name: str) -> Column:
        return F.when(~F.col(f"_{name}_blank"), number[name])

    def required_reason(name: str) -> Column:
        return F.when(present(name) & F.col(f"_{name}_blank"), F.lit(f"{name}_empty")).when(
            ~F.col(f"_{name}_blank") & number[name].isNull(), F.lit(f"{name}_not_numeric")
        )

    odo, soc = required("odometer"), required("soc")
    speed = F.when(~F.col("_speed_token"), number["speed"])
    # array_compact is a higher-order function, so this projection is compiled
    # on its own rather than fused into one whole-stage method: measured 1.6x
    # faster here, since a fused method this large is too big for the JIT.
    reasons = F.array_compact(
        F.array(
            F.when(F.size(miss) > 0, F.concat(F.lit("missing_columns:"), F.array_join(miss, ","))),
            _reason(F.col("_bad_encoding"), "encoding_invalid"),
            _reason(F.col("_too_long"), "record_too_long"),
            _reason(vid.isNull() | (F.length(vid) == 0), "vehicle_id_empty"),
            _reason(F.length(vid) > VEHICLE_ID_MAX_LENGTH, "vehicle_id_too_long"),
            _reason(present("timestamp") & F.col("_ts_blank"), "timestamp_empty"),
            _reason(~F.col("_ts_blank") & F.col("_ts").isNull(), "timestamp_invalid"),
            _reason(~F.col("_speed_token") & number["speed"].isNull(), "speed_not_numeric"),
            required_reason("odometer"),
            # NaN compares greater than every number in Spark, so test it explicitly.
            _reason(odo.isNotNull() & (F.isnan(odo) | (odo < 0)), "odometer_negative"),
            required_reason("soc"),
            _reason(soc.isNotNull() & (F.isnan(soc) | (soc < 0) | (soc > 100)), "soc_out_of_range"),
            required_reason("elevation"),
            _reason(F.length("_shift") > 1, "shift_state_too_long"),
        )
    )
    typed = facts.select(
        *keep,
        "vehicle_id",
        F.col("_ts").alias("timestamp"),
        speed.alias("speed"),
        odo.alias("odometer"),
        soc.alias("soc"),
        required("elevation").alias("elevation"),
        F.upper("_shift").alias("shift_state"),
        *[f"raw_{c}" for c in REQUIRED_COLUMNS],
        reasons.alias("reject_reasons"),
    )
    # Row and reject counts as observed metrics. The CollectMetrics node is
    # also a plan barrier: a later filter on validity is not pushed below it,
    # so the reasons are computed once instead of being inlined into the
    # predicate (which would repeat every regex and cast inside it).
    return typed.observe(
        f"validation_{next(_OBSERVATION_IDS)}",
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.size("reject_reasons") > 0).alias("rows_rejected"),
    )


def is_valid() -> Column:
    return F.size("reject_reasons") == F.lit(0)


def _passthrough(validated: DataFrame) -> list[str]:
    """Columns the caller brought along (file, row number, ids, load id)."""
    own = set(TYPED_COLUMNS) | {f"raw_{c}" for c in REQUIRED_COLUMNS} | {"reject_reasons"}
    return [c for c in validated.columns if c not in own]


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(is_valid()).select(*_passthrough(validated), *TYPED_COLUMNS)


def rejected_rows(validated: DataFrame) -> DataFrame:
    """K7: what the reference only counted and dropped, kept with its reasons."""
    return validated.filter(~is_valid()).select(
        *_passthrough(validated), "vehicle_id", *[f"raw_{c}" for c in REQUIRED_COLUMNS], "reject_reasons"
    )


def validity_counts(validated: DataFrame) -> DataFrame:
    """``rows_read, rows_valid, rows_rejected`` in one aggregate; the
    two counts always add up to the rows read."""
    ok = is_valid()
    return validated.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(ok).alias("rows_valid"),
        F.count_if(~ok).alias("rows_rejected"),
    )


def first_invalid_row(validated: DataFrame) -> DataFrame:
    """F8: per file, the first rejected row (as "Invalid row N") and its reasons.

    ``min_by`` is a plain aggregate: partial per task, then merged, so a
    huge file with many bad rows never lands in one task whole.
    """
    bad = validated.filter(~is_valid())
    return bad.groupBy("source_file").agg(
        F.min("row_number").alias("first_invalid_row"),
        F.min_by("reject_reasons", "row_number").alias("reject_reasons"),
        F.count(F.lit(1)).alias("invalid_rows"),
    )


def held_with_bad_files(validated: DataFrame, broadcast_bytes: int = BAD_FILES_BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(the validated rows, source_file of every file with a rejected row)`` for a whole-file rule.

    Such a rule reads its rows twice: for the bad files, and for what it keeps. So they are parsed and validated once and
    written to the shared scratch folder; the list of files then reads two columns. It is one row per file, broadcast
    while its measured size is small, so that the rows are not shuffled by file; otherwise the join shuffles both."""
    spark = validated.sparkSession
    path = scratch_path(spark, "validated")
    validated.write.parquet(path)
    rows = spark.read.schema(validated.schema).parquet(path)
    bad_files = rows.filter(~is_valid()).select("source_file").distinct()
    size = bad_files.agg(F.sum(F.octet_length("source_file") + F.lit(48))).first()[0] or 0
    return rows, F.broadcast(bad_files) if size <= broadcast_bytes else bad_files


def strict_files(validated: DataFrame) -> DataFrame:
    """whole-file rejection — rows of files without any rejected row (see :func:`held_with_bad_files`)."""
    rows, bad_files = held_with_bad_files(validated)
    return rows.join(bad_files, "source_file", "left_anti")


__all__ = [
    "first_invalid_row",
    "held_with_bad_files",
    "is_valid",
    "rejected_rows",
    "strict_files",
    "valid_rows",
    "validate",
    "validity_counts",
]

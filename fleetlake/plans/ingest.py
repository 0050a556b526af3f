"""Batch ingest: parse → validate → first-wins → anti join → ids → write.

Ids are dense per load in ``(observed_date, vehicle_id, timestamp)`` order.

One plan for the directory loader, the single-file import and every stream
micro-batch. Counts are always ``read = inserted + skipped + rejected``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.operators import validate as v
from fleetlake.operators.dedup import KEY, dedup_first, insert_new
from fleetlake.operators.identity import assign_ids
from fleetlake.session import ensure_conf
from fleetlake.sinks import table as sink
from fleetlake.sinks.key_index import KeyIndex, insert_new_indexed
from fleetlake.sources.lines import ParsedLines

MODES = ("permissive", "strict")

# Batch keys are broadcast for the history lookup only below this size
# (measured: the vehicle id's bytes, plus timestamp and hash-table overhead).
KEY_OVERHEAD_BYTES = 64
BROADCAST_KEYS_BYTES = 32 * 1024 * 1024

# Rows per range partition when numbering and writing a load (~100–200 MB).
ROWS_PER_ID_PARTITION = 1_000_000


@dataclass
class IngestResult:
    ingest_id: str
    rows_read: int
    rows_inserted: int
    rows_skipped: int
    rows_rejected: int
    files_rejected: int
    max_id: int | None = None
    days: tuple[str, ...] = ()  # UTC days the load touched: refresh_mart_days(…, days)

    def as_dict(self) -> dict:
        return dict(self.__dict__)


def apply_mode(validated: DataFrame, mode: str) -> DataFrame:
    """``permissive``: each bad row is rejected alone. ``strict``: a file with
    any bad row is rejected whole (the batch importer's rule); its good rows
    get the reason ``file_rejected``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "permissive":
        return validated
    rows, bad_files = v.held_with_bad_files(validated)
    flagged = rows.join(bad_files.withColumn("_bad", F.lit(True)), "source_file", "left")
    reasons = F.when(
        F.col("_bad") & (F.size("reject_reasons") == F.lit(0)), F.array(F.lit("file_rejected"))
    ).otherwise(F.col("reject_reasons"))
    return flagged.withColumn("reject_reasons", reasons).drop("_bad")


def id_range(
    spark: SparkSession, table_path: str, audit_path: str | None, ingest_id: str
) -> tuple[int, tuple[int, int] | None]:
    """``(largest id given to other loads, this load's recorded (base, last))``.

    The id log has one small row per load. Only while no other load is in it
    (a table written before there was a log) the table and the ingest log are
    asked too, and the largest answer counts."""
    own = F.col("ingest_id") == F.lit(ingest_id)
    log = sink.read_id_log(spark, table_path).agg(
        F.max(F.when(~own, F.col("last"))).alias("others"),
        F.max(F.when(own, F.col("base"))).alias("base"),
        F.max(F.when(own, F.col("last"))).alias("last"),
    ).first()
    highest = log["others"]
    if highest is None:
        known = sink.read_table(spark, table_path).filter(~own).agg(F.max("id")).first()[0]
        if audit_path:
            logged = sink.read_audit(spark, audit_path).filter(~own).agg(F.max("max_id")).first()[0]
            known = max(known or 0, logged or 0)
        highest = known or 0
    return int(highest), None if log["base"] is None else (int(log["base"]), int(log["last"]))


def ingest_parsed(
    spark: SparkSession,
    parsed: ParsedLines,
    table_path: str,
    ingest_id: str,
    mode: str = "permissive",
    rejects_path: str | None = None,
    audit_path: str | None = None,
    id_base: int | None = None,
    key_index: KeyIndex | None = None,
    broadcast_bytes: int = BROADCAST_KEYS_BYTES,
) -> IngestResult:
    """Load one batch of parsed CSV lines into the table, idempotently.

    Replaying the same ``ingest_id`` with the same input rewrites the same
    partitions with the same rows and ids: a load's id range is recorded beside
    the table before its rows are written, and a replay finds it. ``id_base``
    (largest id of other loads) may be passed by a caller that tracks it and
    knows that this is no replay, e.g. a running stream. A batch whose keys
    exceed ``broadcast_bytes`` is compared with ``key_index``, where one is
    given, instead of a shuffle of the history of its days.
    """
    ensure_conf(spark)
    validated = apply_mode(v.validate(parsed.records), mode).persist(StorageLevel.MEMORY_AND_DISK)
    helpers: list[DataFrame] = [validated]
    try:
        valid = v.valid_rows(validated)
        winners = dedup_first(valid)
        # One small job over the cached rows: the days and time span the batch
        # can touch, and how many keys it has (bounds the broadcast below).
        span = valid.agg(
            F.collect_set(F.to_date("timestamp").cast("string")).alias("dates"),
            # Epoch micros, not datetimes: a round trip through Python values
            # would pass through the driver's local zone (ambiguous at DST changes).
            F.min(F.unix_micros("timestamp")).alias("t0"),
            F.max(F.unix_micros("timestamp")).alias("t1"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.octet_length("vehicle_id") + F.lit(KEY_OVERHEAD_BYTES)).alias("key_bytes"),
        ).first()
        history = sink.history_for(spark, table_path, list(span["dates"] or []), exclude_ingest=ingest_id)
        if span["n"]:
            history = history.filter(
                F.col("timestamp").between(F.timestamp_micros(F.lit(span["t0"])), F.timestamp_micros(F.lit(span["t1"])))
            )
        small = int(span["key_bytes"] or 0) <= broadcast_bytes
        if small:
            # Small batch against a big day of history: scan the day's keys once,
            # keep those that match the broadcast batch keys (no shuffle of the
            # history), then anti join against those few matches.
            batch_keys = winners.select(*KEY)
            history = history.select(*KEY).join(F.broadcast(batch_keys), list(KEY), "left_semi")
        if key_index is not None and not small:
            new_rows = insert_new_indexed(spark, winners, table_path, key_index, ingest_id)
        else:
            new_rows = insert_new(winners, history)
        new_rows = new_rows.persist(StorageLevel.MEMORY_AND_DISK)
        helpers.append(new_rows)

        # Ids follow (date, vehicle, time): each range partition then covers one
        # or two days, so the partitioned write opens few files per task even
        # for a backfill of years.
        to_number = (new_rows.drop("id") if "id" in new_rows.columns else new_rows).withColumn(
            "observed_date", F.to_date("timestamp")
        )
        # Partitions sized by the batch (same count on a replay, so the same ids):
        # a small micro-batch is not spread over hundreds of tasks and files.
        parts = max(1, -(-int(span["n"] or 0) // ROWS_PER_ID_PARTITION))
        with_ids, numbered = assign_ids(
            to_number, 0, order=("observed_date", "vehicle_id", "timestamp"), num_partitions=parts
        )
        helpers.append(numbered)

        per_file_new = with_ids.groupBy("source_file").agg(
            F.count(F.lit(1)).alias("rows_inserted"),
            F.min("id").alias("min_id"),
            F.max("id").alias("max_id"),
        )
        ok = v.is_valid()
        per_file = validated.groupBy("source_file").agg(
            F.count(F.lit(1)).alias("rows_read"),
            F.count_if(ok).alias("rows_valid"),
            F.count_if(~ok).alias("rows_rejected"),
        )
        # Every listed file is part of the load, also one without rows or bytes.
        zero = F.lit(0).cast("long")
        audit = (
            parsed.files.select(
                "source_file", "data_rows", (F.size("missing_columns") > 0).alias("bad_header")
            )
            .join(per_file, "source_file", "left")
            .join(per_file_new, "source_file", "left")
            .withColumns({c: F.coalesce(c, zero) for c in ("rows_read", "rows_valid", "rows_rejected", "rows_inserted")})
            .withColumn("rows_skipped", F.col("rows_valid") - F.col("rows_inserted"))
            .withColumn("ingest_id", F.lit(ingest_id))
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        helpers.append(audit)

        totals = audit.agg(
            F.sum("rows_read"), F.sum("rows_inserted"), F.sum("rows_skipped"), F.sum("rows_rejected"),
            F.count_if((F.col("rows_rejected") > 0) | F.col("bad_header")), F.max("max_id"), F.count(F.lit(1)),
            F.sum("data_rows"),
        ).first()
        if int(totals[0] or 0) != int(totals[7] or 0):
            raise RuntimeError(f"{totals[7]} data lines were counted but {totals[0]} were read; nothing was written")

        inserted = int(totals[1] or 0)
        if id_base is not None:
            base = id_base
        else:
            highest, own = id_range(spark, table_path, audit_path, ingest_id)
            # A replay keeps its range; one that has grown gets a new one behind all others.
            if own is not None and inserted <= own[1] - own[0]:
                base = own[0]
            else:
                base = max(highest, own[1] if own else 0)
        sink.write_id_range(spark, table_path, ingest_id, base, base + inserted, finished=False)
        with_ids = with_ids.withColumn("id", F.col("id") + F.lit(base))
        audit = audit.withColumns({c: F.col(c) + F.lit(base) for c in ("min_id", "max_id")})
        sink.write_telemetry(with_ids, table_path, ingest_id)
        if rejects_path:
            sink.write_rejects(v.rejected_rows(validated), rejects_path, ingest_id)
        if audit_path:
            sink.write_audit(audit, audit_path, n_rows=int(totals[6] or 0))
        sink.write_id_range(spark, table_path, ingest_id, base, base + inserted, finished=True)
        return IngestResult(
            ingest_id=ingest_id,
            rows_read=int(totals[0] or 0),
            rows_inserted=int(totals[1] or 0),
            rows_skipped=int(totals[2] or 0),
            rows_rejected=int(totals[3] or 0),
            files_rejected=int(totals[4] or 0),
            max_id=base + inserted,
            days=tuple(sorted(span["dates"] or [])),
        )
    finally:
        # Newest first: dropping a cache that others were built on makes
        # Spark re-plan every dependent cache.
        for df in reversed(helpers):
            df.unpersist()
        parsed.release()


def per_file_counts(
    spark: SparkSession, audit_path: str, ingest_id: str | None = None, family: bool = False
) -> DataFrame:
    """A8 / S1 output: ``file: inserted=…, skipped=…`` as rows, by file name.
    ``family=True`` includes the chunks ``<ingest_id>-<k>`` of a batched load."""
    audit = sink.read_audit(spark, audit_path)
    if ingest_id is not None:
        own = F.col("ingest_id") == F.lit(ingest_id)
        if family:
            own = own | F.col("ingest_id").startswith(F.lit(f"{ingest_id}-"))
        audit = audit.filter(own)
    return audit.orderBy("source_file")


def load_directory(
    spark: SparkSession,
    directory: str,
    table_path: str,
    ingest_id: str,
    mode: str = "strict",
    rejects_path: str | None = None,
    audit_path: str | None = None,
    recursive: bool = False,
    files_per_batch: int | None = None,
    key_index: KeyIndex | None = None,
) -> IngestResult:
    """S1 + ingest: every ``*.csv`` of a directory, vehicle id from the file name.

    The default ``strict`` mode is the batch importer's whole-file rule.
    ``files_per_batch`` splits a large backfill into consecutive loads of that
    many files (sorted by name), ingest ids ``<ingest_id>-<k>``, so what one
    load caches stays bounded; re-running with the same listing replays the
    same groups. The result sums the loads."""
    from fleetlake.sources.csv_files import file_batches, read_csv_directory, read_csv_files

    if not files_per_batch:
        parsed = read_csv_directory(spark, directory, recursive=recursive)
        return ingest_parsed(spark, parsed, table_path, ingest_id, mode, rejects_path, audit_path, key_index=key_index)
    total: IngestResult | None = None
    for k, group in enumerate(file_batches(spark, directory, files_per_batch, recursive)):
        parsed = read_csv_files(spark, group)
        res = ingest_parsed(spark, parsed, table_path, f"{ingest_id}-{k}", mode, rejects_path, audit_path, key_index=key_index)
        total = res if total is None else IngestResult(
            ingest_id=ingest_id,
            rows_read=total.rows_read + res.rows_read,
            rows_inserted=total.rows_inserted + res.rows_inserted,
            rows_skipped=total.rows_skipped + res.rows_skipped,
            rows_rejected=total.rows_rejected + res.rows_rejected,
            files_rejected=total.files_rejected + res.files_rejected,
            max_id=res.max_id,
            days=tuple(sorted(set(total.days) | set(res.days))),
        )
    return total


def import_file(
    spark: SparkSession,
    path: str,
    vehicle_id: str,
    table_path: str,
    ingest_id: str,
    rejects_path: str | None = None,
    audit_path: str | None = None,
) -> IngestResult:
    """S3 + ingest: one uploaded file under a caller-given vehicle id, whole-file rule."""
    from fleetlake.sources.csv_files import read_csv_file

    parsed = read_csv_file(spark, path, vehicle_id)
    return ingest_parsed(spark, parsed, table_path, ingest_id, "strict", rejects_path, audit_path)

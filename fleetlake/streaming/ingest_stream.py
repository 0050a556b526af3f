"""Structured Streaming ingest of CSV files.

``readStream.text`` watches a directory; each micro-batch goes through the
same line parser and ingest plan as a batch load (``foreachBatch``). The
file source's checkpoint remembers which files were taken, so a restart does
not re-read them.

Replay safety: a micro-batch writes only partitions tagged with its own
``ingest_id = <query id>-<batch id>``. The query id is stable for one
checkpoint, so when a batch is re-run after a crash (written but not yet
committed) it overwrites exactly what it wrote before. If the checkpoint is
removed, the new query id gives new ingest ids, every file is read again and
the anti join against stored keys skips all rows already present.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlake.plans.ingest import ingest_parsed
from fleetlake.session import ensure_conf
from fleetlake.sources.lines import lines_from_stream_batch, parse_lines

TRIGGER_INTERVAL = "10 seconds"


def stream_lines(
    spark: SparkSession,
    input_dir: str,
    recursive: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The watched directory as ``value, file_path, block_start`` lines."""
    reader = spark.readStream.format("text").option("pathGlobFilter", "*.csv")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(input_dir).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The stable query id: from the micro-batch thread's local property, or
    from the checkpoint's metadata file (same value, written at first start)."""
    qid = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if qid:
        return qid
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"]


def make_batch_writer(
    table_path: str,
    checkpoint: str,
    rejects_path: str | None = None,
    audit_path: str | None = None,
    log=print,
):
    """The ``foreachBatch`` function. Persists the batch's lines once,
    runs the ingest plan and logs ``batch=… valid=… rejected=…``."""

    # Largest id written so far, carried from batch to batch in the driver.
    # The first batch after a (re)start reads it from storage, excluding its
    # own ingest id, so a replayed batch gets the same base as before.
    state: dict[str, int | None] = {"max_id": None}

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_conf(spark)
        ingest_id = f"{_query_id(spark, checkpoint)}-{batch_id}"
        parsed = parse_lines(lines_from_stream_batch(batch), cache=True)
        result = ingest_parsed(
            spark, parsed, table_path, ingest_id, "permissive", rejects_path, audit_path,
            id_base=state["max_id"],
        )
        state["max_id"] = result.max_id
        log(
            f"batch={batch_id} read={result.rows_read} valid={result.rows_inserted + result.rows_skipped} "
            f"rejected={result.rows_rejected} inserted={result.rows_inserted} skipped={result.rows_skipped}"
        )

    return process


def start_ingest_stream(
    spark: SparkSession,
    input_dir: str,
    table_path: str,
    checkpoint: str,
    rejects_path: str | None = None,
    audit_path: str | None = None,
    available_now: bool = False,
    trigger_interval: str = TRIGGER_INTERVAL,
    max_files_per_trigger: int | None = None,
    recursive: bool = False,
    log=print,
) -> StreamingQuery:
    """Start the stream. ``available_now`` drains what is there and
    stops (tests, backfills); otherwise a processing-time trigger."""
    ensure_conf(spark)
    lines = stream_lines(spark, input_dir, recursive, max_files_per_trigger)
    writer = (
        lines.writeStream.foreachBatch(make_batch_writer(table_path, checkpoint, rejects_path, audit_path, log))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger_interval)
    return writer.start()


def run_available_now(spark: SparkSession, input_dir: str, table_path: str, checkpoint: str, **kwargs) -> None:
    """Drain the directory once and wait for the query to end."""
    query = start_ingest_stream(spark, input_dir, table_path, checkpoint, available_now=True, **kwargs)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))

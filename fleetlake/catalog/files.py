"""Registered queries that need real CSV files: scans, imports, streams.

The files are written by Spark from the driver's ``events`` table (see
``derived.raw_records``) into a fresh folder under the shared checkpoint
root: one ``<date>/<vehicle>.csv`` per vehicle and day, rows in ``event_id``
order. Vehicles 0–5 use the standard header; vehicle ``v`` of 6–8 rotates it
left by ``v - 4`` and puts an extra column at place ``v - 5``; vehicle 9 leaves
out the one at place ``9 % 5``. The SQL oracle states the
expected result per file from the same rules, numbering rows by ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.catalog.derived import EXPECTED_CTE, RAW_RECORDS_CTE, raw_records
from fleetlake.catalog.registry import register, with_ctes
from fleetlake.operators import validate as v
from fleetlake.plans.ingest import apply_mode, ingest_parsed
from fleetlake.schema import REQUIRED_COLUMNS
from fleetlake.session import scratch_path
from fleetlake.sinks import table as sink
from fleetlake.sources.csv_files import header_contract as header_contract_of
from fleetlake.sources.csv_files import read_csv_directory, read_uploads
from fleetlake.sources.tables import driver_table, driver_telemetry
from fleetlake.streaming.ingest_stream import run_available_now

EXTRA_COLUMN = "trip"


def layout(vehicle: int) -> tuple[str, ...]:
    """The header of a vehicle's files, by its number (user_id % 10)."""
    columns = list(REQUIRED_COLUMNS)
    if vehicle in (6, 7, 8):
        columns = columns[vehicle - 4:] + columns[:vehicle - 4]
        columns.insert(vehicle - 5, EXTRA_COLUMN)
    elif vehicle == 9:
        del columns[vehicle % 5]
    return tuple(columns)


# Vehicles by header.
LAYOUTS = ((tuple(range(0, 6)), layout(0)), *(((v,), layout(v)) for v in (6, 7, 8, 9)))
SPLIT_DATE = "2024-01-16"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def csv_cell(c: F.Column) -> F.Column:
    """One CSV field: quoted when it holds a comma, quote or line break; NULL → empty."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(c.rlike('[",\r\n]'), quoted).otherwise(c), F.lit(""))


def _with_breaks(rows: DataFrame) -> DataFrame:
    """The same records, with quoted line breaks: before the speed of every seventh row, and in every fifth row's
    extra column, between quotes and commas."""
    speed = F.when(F.col("id") % 7 == 0, F.concat(F.lit("\n"), "speed")).otherwise(F.col("speed"))
    extra = F.when(F.col("id") % 5 == 0, F.lit('leg "one",\n"leg" two,\nend')).otherwise(F.col(EXTRA_COLUMN))
    return rows.withColumns({"speed": speed, EXTRA_COLUMN: extra})


def write_csv_tree(spark: SparkSession, sf_dir: str, breaks: bool = False) -> str:
    """Write the derived CSV files in one job; returns the folder holding ``<date>/``. ``breaks`` puts quoted line
    breaks into cells where they change no value (:func:`_with_breaks`).

    Every line (a header line per file, then its rows in ``event_id`` order)
    is built as text, so the three header layouts go out in a single
    partitioned write. Rows are hash-partitioned by file; a file is one
    vehicle's day, so no task holds more than that."""
    base = scratch_path(spark, "csv-tree")
    stage, dest = f"{base}/stage", f"{base}/files"
    raw = raw_records(driver_table(spark, sf_dir, "events")).withColumn(EXTRA_COLUMN, F.lit("x"))
    raw = _with_breaks(raw) if breaks else raw
    vnum = F.substring("vehicle_id", 5, 4).cast("int")
    # Each cell is written once, whatever the layout, by one function over the row's cells; five layouts of all cells
    # in one projection were a method too large for the JIT.
    names = (*REQUIRED_COLUMNS, EXTRA_COLUMN)
    written = raw.select("file_date", "vehicle_id", "id", F.transform(F.array(*[F.col(c) for c in names]), csv_cell).alias("_cells"))
    line, header = None, None
    for vehicles, columns in LAYOUTS:
        in_layout = vnum.isin(list(vehicles))
        text = F.concat_ws(",", *[F.col("_cells")[names.index(c)] for c in columns])
        line = F.when(in_layout, text) if line is None else line.when(in_layout, text)
        header = F.when(in_layout, F.lit(",".join(columns))) if header is None else header.when(
            in_layout, F.lit(",".join(columns))
        )
    rows = written.select("file_date", "vehicle_id", F.col("id").alias("_order"), line.alias("value"))
    headers = (
        raw.select("file_date", "vehicle_id").distinct()
        .select("file_date", "vehicle_id", F.lit(-1).cast("long").alias("_order"), header.alias("value"))
    )
    # An explicit partition count keeps AQE from coalescing this write into a
    # handful of tasks (the rows are small, the file count is not).
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.unionByName(headers)
        .repartition(n, "file_date", "vehicle_id")
        .sortWithinPartitions("file_date", "vehicle_id", "_order")
        .select("file_date", "vehicle_id", "value")
        .write.mode("overwrite")
        .partitionBy("file_date", "vehicle_id")
        .text(stage)
    )
    # One part file per (date, vehicle): rename it to <date>/<vehicle>.csv.
    fs, Path = _fs(spark, stage)
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    made: set[str] = set()
    for status in fs.globStatus(Path(f"{stage}/file_date=*/vehicle_id=*/part-*")):
        src = status.getPath()
        parent = src.getParent()
        vehicle = unescape(parent.getName().split("=", 1)[1])
        day = unescape(parent.getParent().getName().split("=", 1)[1])
        if day not in made:
            fs.mkdirs(Path(f"{dest}/{day}"))
            made.add(day)
        if not fs.rename(src, Path(f"{dest}/{day}/{vehicle}.csv")):
            raise RuntimeError(f"could not rename {src}")
    return dest


def _relative(col: str = "source_file") -> F.Column:
    """``<date>/<vehicle>.csv`` of a file's path."""
    return F.substring_index(F.col(col), "/", -2)


# Expected rows per file: layout, file name, row number (header is row 1).
FILES_CTE = """files AS (
    SELECT e.*, CAST(substr(vehicle_id, 5) AS INTEGER) AS v,
           file_date || '/' || vehicle_id || '.csv' AS source_file,
           row_number() OVER (PARTITION BY file_date, vehicle_id ORDER BY id) + 1 AS row_number
    FROM expected e
), checked AS (
    SELECT *, CASE WHEN v = 9 THEN concat_ws(';', 'missing_columns:elevation', NULLIF(reasons, ''))
                   ELSE reasons END AS file_reasons
    FROM files
)"""
_CTES = with_ctes(RAW_RECORDS_CTE, EXPECTED_CTE, FILES_CTE)
_TYPED = """vehicle_id, "timestamp", speed, odometer, soc, elevation, shift_state"""


@register(
    "ingest_counts_by_file",
    _CTES
    + """SELECT source_file, count(*) AS rows_read,
       count(*) FILTER (WHERE file_reasons = '') AS rows_valid,
       count(*) FILTER (WHERE file_reasons <> '') AS rows_rejected,
       count(*) FILTER (WHERE file_reasons = '' AND id % 3 <> 0) AS rows_inserted,
       count(*) FILTER (WHERE file_reasons = '' AND id % 3 = 0) AS rows_skipped
FROM checked GROUP BY source_file""",
)
def ingest_counts_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + A8: load the whole CSV tree (row-level rejection) into a table that
    already holds every third row; per-file read/valid/rejected/inserted/skipped."""
    tree = write_csv_tree(spark, sf_dir)
    base = scratch_path(spark, "ingest")
    table, audit = f"{base}/table", f"{base}/audit"
    seed = driver_telemetry(spark, sf_dir).filter(F.col("id") % F.lit(3) == F.lit(0))
    sink.write_telemetry(seed, table, "seed")
    parsed = read_csv_directory(spark, tree, recursive=True)
    ingest_parsed(spark, parsed, table, "csv-load", "permissive", audit_path=audit)
    counts = sink.read_audit(spark, audit).filter(F.col("ingest_id") == F.lit("csv-load"))
    return counts.select(
        _relative().alias("source_file"), "rows_read", "rows_valid", "rows_rejected", "rows_inserted", "rows_skipped"
    )


@register(
    "header_contract",
    _CTES
    + """SELECT source_file,
       CASE WHEN v <= 5 THEN 'timestamp,speed,odometer,soc,elevation,shift_state'
            WHEN v = 6 THEN 'odometer,trip,soc,elevation,shift_state,timestamp,speed'
            WHEN v = 7 THEN 'soc,elevation,trip,shift_state,timestamp,speed,odometer'
            WHEN v = 8 THEN 'elevation,shift_state,timestamp,trip,speed,odometer,soc'
            ELSE 'timestamp,speed,odometer,soc,shift_state' END AS header,
       CASE WHEN v = 9 THEN 'elevation' ELSE '' END AS missing_columns,
       v <> 9 AS header_ok,
       count(*) AS data_rows
FROM checked GROUP BY source_file, v""",
)
def header_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, missing columns and row count of every file."""
    parsed = read_csv_directory(spark, write_csv_tree(spark, sf_dir), recursive=True)
    return header_contract_of(parsed).withColumn("source_file", _relative())


@register(
    "vehicle_id_from_path",
    _CTES + "SELECT DISTINCT source_file, vehicle_id FROM checked",
)
def vehicle_id_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle id = stem of each file's name."""
    parsed = read_csv_directory(spark, write_csv_tree(spark, sf_dir), recursive=True)
    return parsed.records.select(_relative().alias("source_file"), "vehicle_id").distinct()


@register(
    "import_single",
    _CTES
    + """SELECT source_file, row_number, 'upload-' || vehicle_id AS vehicle_id, "timestamp",
       file_reasons AS reasons
FROM checked""",
)
def import_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: every file imported as an upload with a caller-given id."""
    tree = write_csv_tree(spark, sf_dir)
    fs, Path = _fs(spark, tree)
    uploads = []
    for status in fs.globStatus(Path(f"{tree}/*/*.csv")):
        path = status.getPath().toString()
        uploads.append((path, "upload-" + status.getPath().getName()[: -len(".csv")]))
    checked = v.validate(read_uploads(spark, uploads).records)
    return checked.select(
        _relative().alias("source_file"), "row_number", "vehicle_id", "timestamp",
        F.array_join("reject_reasons", ";").alias("reasons"),
    )


@register(
    "quoted_line_breaks",
    _CTES
    + """SELECT source_file, row_number, vehicle_id, "timestamp", speed, odometer, soc,
       CASE WHEN v = 9 THEN NULL ELSE elevation END AS elevation, shift_state, file_reasons AS reasons FROM checked""",
)
def quoted_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose cells hold quoted line breaks, with values, reasons and record numbers of every row."""
    tree = write_csv_tree(spark, sf_dir, breaks=True)
    checked = v.validate(read_csv_directory(spark, tree, recursive=True).records)
    return checked.select(
        _relative().alias("source_file"), "row_number", *v.TYPED_COLUMNS,
        F.array_join("reject_reasons", ";").alias("reasons"),
    )


@register(
    "first_invalid_row",
    _CTES
    + """SELECT source_file, min(row_number) AS first_invalid_row,
       arg_min(file_reasons, row_number) AS reasons, count(*) AS invalid_rows
FROM checked WHERE file_reasons <> '' GROUP BY source_file""",
)
def first_invalid_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: per file, "Invalid row N" and its reasons."""
    parsed = read_csv_directory(spark, write_csv_tree(spark, sf_dir), recursive=True)
    first = v.first_invalid_row(v.validate(parsed.records))
    return first.select(
        _relative().alias("source_file"), "first_invalid_row",
        F.array_join("reject_reasons", ";").alias("reasons"), "invalid_rows",
    )


@register(
    "strict_files",
    _CTES
    + f"""SELECT source_file, row_number, {_TYPED} FROM checked
WHERE source_file NOT IN (SELECT source_file FROM checked WHERE file_reasons <> '')""",
)
def strict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole-file rule — only files without any bad row load."""
    parsed = read_csv_directory(spark, write_csv_tree(spark, sf_dir), recursive=True)
    kept = v.valid_rows(apply_mode(v.validate(parsed.records), "strict"))
    return kept.select(
        _relative().alias("source_file"), "row_number",
        "vehicle_id", "timestamp", "speed", "odometer", "soc", "elevation", "shift_state",
    )


_STREAM_SQL = _CTES + f"SELECT {_TYPED} FROM checked WHERE file_reasons = ''"


def _table_rows(spark: SparkSession, table: str) -> DataFrame:
    return sink.read_table(spark, table).select(
        "vehicle_id", "timestamp", "speed", "odometer", "soc", "elevation", "shift_state"
    )


def _stream_paths(spark: SparkSession, label: str) -> dict[str, str]:
    base = scratch_path(spark, label)
    return {k: f"{base}/{k}" for k in ("table", "audit", "rejects", "checkpoint", "input")}


def _quiet(_msg: str) -> None:
    return None


@register("stream_ingest", _STREAM_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV tree drained by the stream, several files per batch."""
    p = _stream_paths(spark, "stream")
    tree = write_csv_tree(spark, sf_dir)
    run_available_now(
        spark, tree, p["table"], p["checkpoint"], rejects_path=p["rejects"], audit_path=p["audit"],
        max_files_per_trigger=64, recursive=True, log=_quiet,
    )
    return _table_rows(spark, p["table"])


def _move_days(spark: SparkSession, tree: str, target: str, before: bool) -> None:
    fs, Path = _fs(spark, tree)
    fs.mkdirs(Path(target))
    for status in fs.listStatus(Path(tree)):
        name = status.getPath().getName()
        if (name < SPLIT_DATE) == before:
            fs.rename(status.getPath(), Path(f"{target}/{name}"))


@register("stream_restart", _STREAM_SQL)
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First half of the days, stop, the rest arrives, restart on the same
    checkpoint: earlier files are not read again, later ones are."""
    p = _stream_paths(spark, "stream-restart")
    tree = write_csv_tree(spark, sf_dir)
    kw = dict(audit_path=p["audit"], max_files_per_trigger=100, recursive=True, log=_quiet)
    _move_days(spark, tree, p["input"], before=True)
    run_available_now(spark, p["input"], p["table"], p["checkpoint"], **kw)
    _move_days(spark, tree, p["input"], before=False)
    run_available_now(spark, p["input"], p["table"], p["checkpoint"], **kw)
    return _table_rows(spark, p["table"])


@register("stream_replay", _STREAM_SQL)
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the last batch is re-run as after a crash between write and commit,
    then the checkpoint is replaced by a new one; no row is lost or doubled."""
    p = _stream_paths(spark, "stream-replay")
    tree = write_csv_tree(spark, sf_dir)
    kw = dict(audit_path=p["audit"], max_files_per_trigger=100, recursive=True, log=_quiet)
    run_available_now(spark, tree, p["table"], p["checkpoint"], **kw)
    fs, Path = _fs(spark, p["checkpoint"])
    commits = sorted(
        (s.getPath() for s in fs.listStatus(Path(f"{p['checkpoint']}/commits")) if s.getPath().getName().isdigit()),
        key=lambda path: int(path.getName()),
    )
    if commits:
        fs.delete(commits[-1], False)
    run_available_now(spark, tree, p["table"], p["checkpoint"], **kw)
    run_available_now(spark, tree, p["table"], p["checkpoint"] + "-new", **kw)
    return _table_rows(spark, p["table"])


"""CSV imports: a directory of ``<vehicle_id>.csv`` files (S1), the header
contract (S2) and a single uploaded file with a caller-given id (S3)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.session import ensure_conf, literal_path
from fleetlake.sources.lines import (
    ParsedLines,
    list_files,
    load_path,
    parse_lines,
    path_key_text,
    scan_lines,
    text_source,
)


def csv_source(spark: SparkSession, directory: str | list[str], recursive: bool = False):
    """The text scan of every ``*.csv`` below ``directory``; ``ValueError`` when there is none."""
    ensure_conf(spark)
    paths = _folders(directory)
    try:
        source = text_source(spark, paths, recursive=recursive)
        has_files = len(source.inputFiles()) > 0
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        has_files = False
    if not has_files:
        raise ValueError(f"No CSV files found in {directory if isinstance(directory, str) else ', '.join(directory)}")
    return source


def _folders(directory: str | list[str]) -> list[str]:
    return [literal_path(d) for d in ([directory] if isinstance(directory, str) else directory)]


def read_csv_directory(
    spark: SparkSession,
    directory: str | list[str],
    recursive: bool = False,
    cache: bool = False,
) -> ParsedLines:
    """Every ``*.csv`` in the directory (sorted by name); the vehicle id
    is each file's stem. Raises ``ValueError`` when there is no CSV file."""
    source = csv_source(spark, directory, recursive)
    return parse_lines(scan_lines(spark, source), cache=cache, listing=list_files(source))


def read_csv_files(spark: SparkSession, paths: list[str]) -> ParsedLines:
    """S1 for a part of a directory: the given loadable paths (see :func:`file_batches`)."""
    source = text_source(spark, paths, glob=None)
    return parse_lines(scan_lines(spark, source), listing=list_files(source))


def file_batches(spark: SparkSession, directory: str | list[str], files_per_batch: int, recursive: bool = False):
    """The directory's files, sorted, in consecutive groups of ``files_per_batch``
    (as loadable paths). Same listing → same groups, so a re-run replays them."""
    if files_per_batch < 1:
        raise ValueError("files_per_batch must be >= 1")
    uris = sorted(csv_source(spark, directory, recursive).inputFiles())
    paths = [load_path(u) for u in uris]
    return [paths[i:i + files_per_batch] for i in range(0, len(paths), files_per_batch)]


def read_csv_file(spark: SparkSession, path: str, vehicle_id: str, cache: bool = False) -> ParsedLines:
    """S3: one file whose vehicle id the caller gives. The name must end in
    ``.csv`` (any case), checked before anything is read."""
    ensure_conf(spark)
    if not vehicle_id:
        raise ValueError("vehicle_id must not be empty")
    if not path or not path.lower().endswith(".csv"):
        raise ValueError("A CSV file is required")
    paths = [literal_path(path)]
    source = text_source(spark, paths, glob=None)
    return parse_lines(scan_lines(spark, source), vehicle_id=vehicle_id, cache=cache, listing=list_files(source))


def read_uploads(spark: SparkSession, uploads: list[tuple[str, str]], cache: bool = False) -> ParsedLines:
    """S3 for many uploads at once: each ``(path, vehicle_id)`` pair is one
    file with its caller-given id (one scan, one job, instead of one per file).
    The ids are a table joined to the splits of the files."""
    ensure_conf(spark)
    if not uploads:
        raise ValueError("no uploads given")
    for path, vehicle_id in uploads:
        if not vehicle_id:
            raise ValueError("vehicle_id must not be empty")
        if not path or not path.lower().endswith(".csv"):
            raise ValueError("A CSV file is required")
    paths = [literal_path(p) for p, _ in uploads]
    source = text_source(spark, paths, glob=None)
    ids = spark.createDataFrame(
        list({path_key_text(spark, p): vid for p, vid in uploads}.items()), "path_key string, vehicle_id string"
    )
    return parse_lines(scan_lines(spark, source), vehicle_id=ids, cache=cache, listing=list_files(source))


def header_contract(parsed: ParsedLines) -> DataFrame:
    """Per file, its header, the missing contract columns (sorted) and
    whether the file may load. Judged from the header itself, so a file
    with a header and no rows is judged too."""
    return parsed.files.select(
        "source_file",
        F.array_join("header", ",").alias("header"),
        F.array_join("missing_columns", ",").alias("missing_columns"),
        (F.size("missing_columns") == F.lit(0)).alias("header_ok"),
        "data_rows",
    )


def missing_columns_message(parsed: ParsedLines) -> DataFrame:
    """The batch path's file error text: ``Missing required columns: a, b``."""
    return parsed.files.filter(F.size("missing_columns") > 0).select(
        "source_file",
        F.concat(F.lit("Missing required columns: "), F.array_join("missing_columns", ", ")).alias("error"),
    )

"""One CSV line parser for batch and stream (§7.3a of the survey).

Spark's CSV reader binds a header-carrying file *by position* against a
given schema and cannot report a physical row number. The contract needs
binding *by header name* (any order, extras allowed, missing columns
reported) and "Invalid row N" messages, for files of any size. So:

1. ``lines``: text scan → ``value, file_path, block_start`` (Hadoop splits,
   a line belongs to the split it starts in); blank lines dropped (the Python
   CSV reader skips them too), then ``line_id = monotonically_increasing_id()``,
   which is contiguous inside one split. How files are split follows settings
   and the cores of the moment, so the text is scanned once: the numbered lines
   are written to the shared scratch folder (a bounded micro-batch is persisted
   instead) and every later step reads those.
2. ``splits``: ``groupBy(file, block)`` → first ``line_id``, line count and
   first line. This is one row per split — tiny next to the data. A window
   over it (partitioned by file) gives each split's running row offset and
   the file's header (first line of its first block).
3. Join back on ``(file, block)``: ``row_number = line_id − first_id +
   offset + 1``. The header is row 1, data starts at 2. The split table is
   broadcast only when its measured size is under the threshold; otherwise
   it is a shuffled join.
4. Cells: ``from_csv`` as wide as the widest header; each contract column is
   the cell at the position of its name in that file's header.

No step keeps a whole file in one task, and no per-row window runs over a
file. A line that is not valid UTF-8 is marked, so that it is rejected. Files
without any line are known from the file listing and lack every column.

Quoted line breaks: a file in which some line, read from its start, ends
inside a quoted cell has records of several lines; the split table knows these
files, and they alone take the way of :mod:`fleetlake.sources.records`.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlake.functions.naming import vehicle_id_from_path
from fleetlake.schema import REQUIRED_COLUMNS
from fleetlake.session import literal_path, scratch_path
from fleetlake.sources import records as quoted

# The split table is broadcast when its estimated size is below this.
SPLIT_TABLE_BROADCAST_BYTES = 64 * 1024 * 1024
GIVEN_ID_BYTES = 160  # a caller's vehicle id of up to 100 characters, on every split of its file
CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
BOM = "\ufeff"  # stripped from a header line if the reader left it there


@dataclass
class ParsedLines:
    """Result of :func:`parse_lines`.

    ``records``: one row per data line — ``source_file, row_number,
    order_key, vehicle_id, missing_columns, bad_encoding`` (and ``too_long``, if records of several lines
    were met) and the six contract columns as text. ``files``: one row per file — ``source_file, header,
    missing_columns, data_rows``. Call :meth:`release` when done if
    ``cache`` was requested.
    """

    records: DataFrame
    files: DataFrame
    width: int
    _cached: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in reversed(self._cached):
            df.unpersist()


def load_path(uri: str) -> str:
    """A listed file URI (``inputFiles`` gives ``car%201.csv``) as a path
    ``load`` reads literally: URI-decoded, glob characters escaped."""
    parts = urlsplit(uri)
    path = literal_path(unquote(parts.path))
    return f"{parts.scheme}://{parts.netloc}{path}" if parts.scheme else path


def text_source(spark: SparkSession, paths: list[str], recursive: bool = False, glob: str | None = "*.csv") -> DataFrame:
    """The text scan over files or folders. Its file listing is taken once,
    when this DataFrame is created, and every job built on it reads exactly
    those files, even if more arrive meanwhile."""
    reader = spark.read.format("text")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths)


def list_files(source: DataFrame) -> DataFrame:
    """``file_path`` of every file that :func:`text_source` listed, also of
    those without a byte, which a scan leaves out. The listing itself is held
    by the driver for any scan; ``files_per_batch`` bounds it for a backfill."""
    return source.sparkSession.createDataFrame([(f,) for f in source.inputFiles()], "file_path string")


def scan_lines(spark: SparkSession, files: list[str] | DataFrame) -> DataFrame:
    """Step 1: non-blank lines with file, split and a per-split running id."""
    raw = files if isinstance(files, DataFrame) else spark.read.format("text").load(files)
    return (
        raw.select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
        .filter(F.col("value") != F.lit(""))
        .withColumn("line_id", F.monotonically_increasing_id())
    )


def lines_from_stream_batch(batch: DataFrame) -> DataFrame:
    """Step 1 for a micro-batch of ``readStream.text`` with ``_metadata`` columns
    already projected as ``file_path`` and ``block_start``."""
    return batch.filter(F.col("value") != F.lit("")).withColumn("line_id", F.monotonically_increasing_id())


def split_table(lines: DataFrame) -> DataFrame:
    """Step 2: one row per split with its row offset and its file's header."""
    per_split = lines.groupBy("file_path", "block_start").agg(
        F.min("line_id").alias("first_line_id"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min_by("value", "line_id").alias("first_line"),
        F.max(quoted.opens(F.col("value"))).alias("opens"),
    )
    by_file = Window.partitionBy("file_path")
    running = by_file.orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    header = F.regexp_replace(F.min_by("first_line", "block_start").over(by_file), "^" + BOM, "")
    return per_split.select(
        "file_path",
        "block_start",
        "first_line_id",
        "n_lines",
        F.coalesce(F.sum("n_lines").over(running), F.lit(0)).alias("line_offset"),
        header.alias("header_line"),
        F.sum("n_lines").over(by_file).alias("file_lines"),
        F.max("opens").over(by_file).alias("breaks"),
    )


def _csv_struct(text: Column, width: int) -> Column:
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    return F.from_csv(text, schema, CSV_OPTIONS)


def _cells(text: Column, width: int) -> Column:
    """Cells as an array (for small inputs such as headers)."""
    parsed = _csv_struct(text, width)
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def _position(header: Column, name: str) -> Column:
    """1-based position of the *last* header cell called ``name`` (a dict
    built from the header keeps the last duplicate), 0 when absent."""
    from_end = F.array_position(F.reverse(header), F.lit(name))
    return F.when(from_end > 0, F.size(header) - from_end + F.lit(1)).otherwise(F.lit(0))


def parse_lines(
    lines: DataFrame,
    vehicle_id: str | DataFrame | None = None,
    cache: bool = False,
    broadcast_bytes: int = SPLIT_TABLE_BROADCAST_BYTES,
    listing: DataFrame | None = None,
) -> ParsedLines:
    """Steps 2–4. ``vehicle_id`` overrides the id taken from the file name: one
    text for all files, or a table ``path_key, vehicle_id`` (joined per split).
    ``listing`` (``file_path``) adds the files that have no line to ``files``.

    Runs one small job over the split table (its width and size). With
    ``cache=True`` the lines are persisted (right for bounded micro-batches);
    otherwise they are written to the shared scratch folder, which costs I/O
    but no executor memory at any input size, and survives a lost executor.
    """
    cached: list[DataFrame] = []
    spark = lines.sparkSession

    def keep(df: DataFrame, label: str) -> DataFrame:
        if cache:
            cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return df
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    lines = keep(lines, "lines")
    splits = split_table(lines).persist(StorageLevel.MEMORY_AND_DISK)
    cached.append(splits)
    stats = splits.agg(
        F.max(F.size(F.split("header_line", ",", -1))).alias("width"),
        F.sum(F.length("file_path") + F.length("header_line") + F.lit(48)).alias("bytes"),
        F.max("breaks").alias("breaks"),
        F.min("breaks").alias("all_break"),
    ).first()
    width = int(stats["width"] or len(REQUIRED_COLUMNS))
    width = max(width, len(REQUIRED_COLUMNS))
    est_bytes = int(stats["bytes"] or 0)
    joined_records: DataFrame | None = None
    if stats["breaks"]:
        few = est_bytes <= broadcast_bytes
        plain = splits.where(~F.col("breaks")).select("file_path", "block_start")
        broken = None if stats["all_break"] else splits.where("breaks")
        joined_records, broken_files = quoted.assemble(
            lines, broken if broken is None or not few else F.broadcast(broken), keep=keep, broadcast=few)
        # Lines of files with such records are not parsed a second time as they stand.
        lines = None if broken is None else lines.join(F.broadcast(plain) if few else plain, ["file_path", "block_start"], "left_semi")
        broken_files = broken_files.persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(broken_files)
        widest = broken_files.agg(F.max(F.size(F.split("header_line", ",", -1)))).first()[0]
        width = max(width, int(widest or 0))
        # What the split table says of these files counts lines; now it counts records.
        counted = broken_files.select("file_path", F.col("header_line").alias("_header"), "n_records")
        splits = splits.drop("breaks").join(F.broadcast(counted) if few else counted, "file_path", "left").select(
            "file_path", "block_start", "first_line_id", "line_offset",
            F.coalesce("_header", "header_line").alias("header_line"), F.coalesce("n_records", "file_lines").alias("file_lines"),
        )

    header = _cells(F.col("header_line"), width)
    header = F.slice(header, 1, F.size(F.split("header_line", ",", -1)))
    # Listed in sorted order, so array_except returns the missing names sorted
    # without an extra array_sort.
    required = F.array(*[F.lit(c) for c in sorted(REQUIRED_COLUMNS)])
    # What follows from a file's name or header is found once per split, not per line.
    split_info = splits.select("file_path", "block_start", "first_line_id", "line_offset", header.alias("header")).select(
        "file_path",
        "block_start",
        "first_line_id",
        "line_offset",
        F.array(*[_position(F.col("header"), name) - F.lit(1) for name in REQUIRED_COLUMNS]).alias("places"),
        F.array_except(required, F.col("header")).alias("missing_columns"),
    )
    if isinstance(vehicle_id, DataFrame):
        split_info = split_info.withColumn("path_key", path_key(F.col("file_path"))).join(
            vehicle_id.select("path_key", "vehicle_id"), "path_key", "left"
        ).drop("path_key")
        est_bytes += vehicle_id.count() * GIVEN_ID_BYTES
    else:
        split_info = split_info.withColumn(
            "vehicle_id", vehicle_id_from_path(F.col("file_path")) if vehicle_id is None else F.lit(vehicle_id)
        )
    join_side = F.broadcast(split_info) if est_bytes <= broadcast_bytes else split_info
    # Parse each line once, before the join: the join keeps Catalyst from
    # inlining the parser into every later use of a cell.
    def parsed(texts: DataFrame, *columns: str) -> DataFrame:
        return texts.withColumn("_csv", _csv_struct(F.col("value"), width)).select(
            "file_path", "block_start", "line_id", *columns, F.array(*[F.col(f"_csv.c{i}") for i in range(width)]).alias("cells")
        ).join(join_side, ["file_path", "block_start"], "inner")

    row_number = F.col("line_id") - F.col("first_line_id") + F.col("line_offset") + F.lit(1)
    joined = None
    if lines is not None:
        checked = lines.select("*", (~F.is_valid_utf8("value")).alias("bad_encoding"))
        joined = parsed(checked, "bad_encoding").withColumn("row", row_number)
    if joined_records is not None:
        several = parsed(joined_records, "bad_encoding", "too_long", "row")
        joined = several if joined is None else joined.withColumn("too_long", F.lit(False)).unionByName(several)
    with_rn = joined.filter(F.col("row") > F.lit(1))
    bound = [F.get(F.col("cells"), F.get(F.col("places"), F.lit(i))).alias(name) for i, name in enumerate(REQUIRED_COLUMNS)]
    records = with_rn.select(
        F.col("file_path").alias("source_file"),
        F.col("row").alias("row_number"),
        # Total order of lines inside a file without extra work: split start, then line id.
        F.struct("block_start", "line_id").alias("order_key"),
        "vehicle_id",
        "missing_columns",
        "bad_encoding",
        *(["too_long"] if joined_records is not None else []),
        *bound,
    )
    per_file = splits.groupBy("file_path").agg(
        F.first("header_line").alias("header_line"), F.first("file_lines").alias("file_lines")
    )
    if listing is not None:
        # A listing spells the empty authority out (file:///), a scan does not (file:/).
        listed = listing.select(path_key(F.col("file_path")).alias("key"), F.col("file_path").alias("listed_path"))
        per_file = (
            per_file.withColumn("key", path_key(F.col("file_path"))).join(listed, "key", "full_outer")
            .withColumn("file_path", F.coalesce("file_path", "listed_path"))
        )
    header_cells = F.slice(_cells(F.col("header_line"), width), 1, F.size(F.split("header_line", ",", -1)))
    files = per_file.select(
        F.col("file_path").alias("source_file"),
        F.when(F.col("header_line").isNull(), F.array().cast("array<string>")).otherwise(header_cells).alias("header"),
        F.coalesce(F.col("file_lines") - F.lit(1), F.lit(0)).alias("data_rows"),
    ).withColumn("missing_columns", F.array_except(required, F.col("header")))
    return ParsedLines(records=records, files=files, width=width, _cached=tuple(cached))


def path_key(path: Column) -> Column:
    """``file_path`` as ``host/path`` without scheme, URI-decoded, to match
    :func:`path_key_text` of a caller's path."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "")


def path_key_text(spark: SparkSession, path: str) -> str:
    """The key of a caller's path, relative or not, as its file system qualifies it."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(hadoop_path).toUri()
    return f"{uri.getAuthority() or ''}{uri.getPath()}".lstrip("/")

"""CSV records of several physical lines: cells with quoted line breaks, over any number of splits.

Whether a line starts inside a quoted cell depends on all lines before it, but only through one bit. A line maps that bit
from its start to its end: it keeps it (no quote), flips it, or sets it whatever it was. So the bit before a line is what
the last setting line set, flipped as often as lines flip after it; without a setting line, the start's bit flipped. That is
two running values of a window over one split (file and block), which is bounded by Spark's split size:

1. every line gets the bit, and the number of records begun so far in its split, for both bits the split may start with;
2. a split is summed up to one row, and a window over the rows of a file, one for each split, composes them: the bit and
   the record number with which each split really starts;
3. joined back, every line knows the number of its record. Lines that are a record by themselves are passed on; the lines
   of the others are gathered by file and record number, and joined with the line break between them.

Only files that have such a record come here, and only the lines of records with breaks are gathered. The lines with the
values of step 1 are held (written to the scratch folder, or persisted for a micro-batch): step 2 and all readers of step 3
start from there, so that no reader runs the windows again. A record of more than
``RECORD_BYTES`` (a quote that is never closed takes in the rest of its file) is not gathered: it becomes one row marked
``too_long``, which is rejected. A quoted cell follows the rules of Python's reader: a quote opens a cell only as its first
character, two quotes inside are one, and what stands between the closing quote and the next comma belongs to the cell.
Blank lines are no records, and inside a cell they are left out of its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a record's lines, at most.
RECORD_BYTES = 1 << 20

# Groups repeat possessively, so a long line is matched without recursion.
_QUOTED = r'(?:[^"]++|"")*+'
_CELLS = rf'(?:(?:[^",][^,]*+|"{_QUOTED}"[^,]*+)?+,)*+'
_OPENS = rf'\A{_CELLS}"{_QUOTED}\z'
_STAYS = rf'\A{_QUOTED}\z'
_REOPENS = rf'\A{_QUOTED}"[^,]*+,{_CELLS}"{_QUOTED}\z'


def opens(value: Column) -> Column:
    """Does a line that starts outside of a cell end inside a quoted one?"""
    return value.contains('"') & value.rlike(_OPENS)


def stays_open(value: Column) -> Column:
    """Does a line that starts inside a quoted cell end inside one?"""
    return ~value.contains('"') | value.rlike(_STAYS) | value.rlike(_REOPENS)


def _flipped(bit: Column, times: Column) -> Column:
    return bit != (F.pmod(times, F.lit(2)) == 1)


def _bit_before(order: Window, sets: Column, to: Column, flips: Column, start: Column) -> tuple[Column, Column]:
    """The bit before each row of a window: ``(how it follows from the last setting row, flips so far)`` for rows that set it
    to ``to`` or flip it ``flips`` times; ``start`` is the bit before the first row."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum(flips).over(before), F.lit(0))
    last = F.last(F.when(sets, F.struct(to.alias("to"), F.col("_flips").alias("flips"))), ignorenulls=True).over(before)
    bit = F.when(last.isNull(), _flipped(start, F.col("_flips"))).otherwise(_flipped(last["to"], F.col("_flips") - last["flips"]))
    return bit, so_far


def line_states(lines: DataFrame) -> DataFrame:
    """Step 1: ``in_0, in_1`` (does the line start inside a cell, if its split starts outside or inside of one) and
    ``begun_0, begun_1`` (records begun in the split up to this line)."""
    order = Window.partitionBy("file_path", "block_start").orderBy("line_id")
    marked = lines.withColumns({"_out": opens(F.col("value")), "_in": stays_open(F.col("value"))})
    sets, flips = F.col("_out") == F.col("_in"), (F.col("_out") & ~F.col("_in")).cast("int")
    found = marked
    for s in (0, 1):
        bit, so_far = _bit_before(order, sets, F.col("_out"), flips, F.lit(bool(s)))
        if not s:
            found = found.withColumn("_flips", so_far)
        found = found.withColumn(f"in_{s}", bit)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumns({f"begun_{s}": F.sum((~F.col(f"in_{s}")).cast("long")).over(upto) for s in (0, 1)}).drop("_flips")


def split_states(states: DataFrame) -> DataFrame:
    """Step 2: ``starts_in``, ``records`` and ``records_before`` of every split."""
    def after(s: int) -> Column:
        return F.when(F.col(f"in_{s}"), F.col("_in")).otherwise(F.col("_out"))

    ends = states.groupBy("file_path", "block_start").agg(
        *[F.max_by(after(s), "line_id").alias(f"end_{s}") for s in (0, 1)], *[F.max(f"begun_{s}").alias(f"n_{s}") for s in (0, 1)])
    order = Window.partitionBy("file_path").orderBy("block_start")
    sets, flips = F.col("end_0") == F.col("end_1"), (F.col("end_0") & ~F.col("end_1")).cast("int")
    bit, so_far = _bit_before(order, sets, F.col("end_0"), flips, F.lit(False))
    placed = ends.withColumn("_flips", so_far).withColumn("starts_in", bit)
    records = F.when(F.col("starts_in"), F.col("n_1")).otherwise(F.col("n_0"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "file_path", "block_start", "starts_in", records.alias("records"),
        F.coalesce(F.sum(records).over(before), F.lit(0)).alias("records_before"))


def _by_itself(df: DataFrame, label: str) -> DataFrame:
    return df


def assemble(
    lines: DataFrame,
    broken: DataFrame | None,
    record_bytes: int = RECORD_BYTES,
    keep: Callable[[DataFrame, str], DataFrame] = _by_itself,
    broadcast: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(records, files)`` of the files that have a row in ``broken`` (``file_path, block_start``, one row a split; None: all).

    ``records``: ``file_path, block_start, line_id`` (place of its first line), ``row`` (the header is row 1), ``value``,
    ``bad_encoding``, ``too_long``. ``files``: ``file_path, n_records, header_line``. ``keep(df, label)`` holds what several
    steps read, so that the windows run once; ``broadcast``: the rows of the splits are few enough to be sent to all tasks."""
    own = lines if broken is None else lines.join(broken.select("file_path", "block_start"), ["file_path", "block_start"], "left_semi")
    marked = own.withColumns({"bad_encoding": ~F.is_valid_utf8("value"), "bytes": F.octet_length("value")})
    states = keep(line_states(marked), "line-states")
    starts = keep(split_states(states), "split-states")
    known = states.join(F.broadcast(starts) if broadcast else starts, ["file_path", "block_start"])
    begun = F.when(F.col("starts_in"), F.col("begun_1")).otherwise(F.col("begun_0"))
    placed = known.select(
        "file_path", "block_start", "line_id", "value", "bytes", (F.col("records_before") + begun).alias("row"),
        F.when(F.col("starts_in"), F.col("in_1")).otherwise(F.col("in_0")).alias("_inside"), "_out", "bad_encoding")
    records = _gathered(placed, record_bytes)
    # Of the text only the first record of a file is asked for; the splits know how many there are.
    headers = _gathered(placed.where(F.col("row") == 1), record_bytes).select(
        "file_path", F.regexp_replace("value", "^\ufeff", "").alias("header_line"))
    counts = starts.groupBy("file_path").agg(F.max(F.col("records_before") + F.col("records")).alias("n_records"))
    return records, counts.join(headers, "file_path", "left").select("file_path", "n_records", "header_line")


def _gathered(placed: DataFrame, record_bytes: int) -> DataFrame:
    """Step 3: one row a record. Lines that are one by themselves are only passed on."""
    # A line inside a cell before any record cannot be: a file starts outside.
    alone = placed.where(~F.col("_inside") & ~F.col("_out")).select(
        "file_path", "block_start", "line_id", "row", "value", "bad_encoding", F.lit(False).alias("too_long"))
    parts = placed.where(F.col("_inside") | F.col("_out"))
    sizes = parts.groupBy("file_path", "row").agg(F.sum(F.col("bytes") + F.lit(1)).alias("size"))
    too_long = sizes.where(F.col("size") > F.lit(record_bytes)).select("file_path", "row", F.lit(True).alias("too_long"))
    gathered = (
        parts.join(too_long, ["file_path", "row"], "left").where(F.col("too_long").isNull() | ~F.col("_inside"))
        .groupBy("file_path", "row").agg(
            F.sort_array(F.collect_list(F.struct("block_start", "line_id", "value"))).alias("parts"),
            F.max("bad_encoding").alias("bad_encoding"), F.coalesce(F.max("too_long"), F.lit(False)).alias("too_long"))
    )
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    several = gathered.select(
        "file_path", F.col("parts")[0]["block_start"].alias("block_start"), F.col("parts")[0]["line_id"].alias("line_id"), "row",
        F.when(~F.col("too_long"), text).otherwise("").alias("value"), "bad_encoding", "too_long")
    return alone.unionByName(several)

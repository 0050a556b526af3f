"""Surrogate ids (I4): dense ``base+1 … base+n`` in key order, no global window.

1. Range-partition and sort the rows by the order columns, then number
   each row inside its partition (``monotonically_increasing_id`` minus the
   partition's start, contiguous right after the sort).
2. Count rows per partition — one row per partition — and turn the counts
   into running offsets with a window over that tiny table.
3. Broadcast the offsets (their size is the partition count) and add.

The numbered rows are persisted so both passes see the same range bounds;
if an executor is lost, its cached partition is recomputed from the same
shuffle with the same bounds, so the ids do not change.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assign_ids(
    df: DataFrame,
    base: int = 0,
    order: tuple[str, ...] = ("vehicle_id", "timestamp"),
    id_col: str = "id",
    num_partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Return ``(rows with id, persisted helper)``; unpersist the helper after use."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id() - (F.col("_part").cast("long") * F.lit(1 << 33)))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: an unpartitioned window here is over at most n rows.
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    with_ids = numbered.join(F.broadcast(offsets), "_part").withColumn(
        id_col, F.lit(base) + F.col("_offset") + F.col("_local") + F.lit(1)
    )
    return with_ids.drop("_part", "_local", "_offset"), numbered

"""An index of the stored keys in buckets (I1, K6): a large batch is compared with all history without moving history.

The index is one of Spark's bucketed tables, ``vehicle_id, timestamp, ingest_id``, in buckets by both key columns (so that a
vehicle with a third of all rows fills every bucket alike). In the anti join only the batch is shuffled, into as many
partitions as there are buckets; the index is scanned bucket by bucket where it lies, and no column beside the keys is read.

The index may lag behind the table: beside it stands the list of the loads that it holds, and the loads that are not in the
list are read from the table itself. :func:`refresh_key_index` folds these in, many at a time, so that micro-batches make
no files in the index. Keys come first and the list second; a refresh that stops in between leaves keys that the next one
adds again, which changes no answer, as keys are only asked for their existence. A load that is replayed finds its own
keys left out by its ingest id.

The table is external and known to the session's catalog by name; a session that does not know it yet registers it from its
path. Give it at least ``spark.sql.shuffle.partitions`` buckets: with fewer, Spark may prefer to shuffle both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fleetlake.operators.dedup import KEY, insert_new
from fleetlake.sinks import table as sink

_LOADS = StructType([StructField("ingest_id", StringType(), False)])


@dataclass(frozen=True)
class KeyIndex:
    """Name in the session's catalog, path of the bucketed table, and its number of buckets (fixed for its life)."""

    name: str
    path: str
    buckets: int

    @property
    def loads_path(self) -> str:
        return f"{self.path.rstrip('/')}-loads"


def register_key_index(spark: SparkSession, index: KeyIndex) -> None:
    """Make the index known to this session, and its folder if there is none yet."""
    path = index.path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{index.name}` (vehicle_id STRING, timestamp TIMESTAMP, ingest_id STRING) USING parquet "
        f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {index.buckets} BUCKETS LOCATION '{path}'")


def indexed_loads(spark: SparkSession, index: KeyIndex) -> DataFrame:
    """``ingest_id`` of the loads whose keys the index holds."""
    return sink._read_or_empty(spark, index.loads_path, _LOADS).distinct()


def _rows_of(spark: SparkSession, table_path: str, loads: DataFrame) -> DataFrame:
    """Keys of the given loads, from the table; ``loads`` has one small row a load and prunes the folders."""
    return sink.read_table(spark, table_path).join(F.broadcast(loads), "ingest_id", "left_semi").select(*KEY, "ingest_id")


def pending_loads(spark: SparkSession, table_path: str, index: KeyIndex) -> DataFrame:
    """``ingest_id`` of the loads in the table that the index does not hold."""
    known = sink.read_id_log(spark, table_path).select("ingest_id")
    return known.join(indexed_loads(spark, index), "ingest_id", "left_anti")


def refresh_key_index(spark: SparkSession, table_path: str, index: KeyIndex) -> int:
    """Fold the pending loads into the index: one shuffle of their keys, one file a bucket. Returns their number."""
    register_key_index(spark, index)
    pending = [r[0] for r in pending_loads(spark, table_path, index).collect()]  # one short text a load
    if not pending:
        return 0
    loads = spark.createDataFrame([(i,) for i in pending], _LOADS)
    (
        _rows_of(spark, table_path, loads).repartition(index.buckets, *KEY)
        .write.mode("append").format("parquet").option("path", index.path)
        .bucketBy(index.buckets, *KEY).sortBy(*KEY).saveAsTable(index.name)
    )
    loads.coalesce(1).write.mode("append").parquet(index.loads_path)
    return len(pending)


def indexed_keys(spark: SparkSession, index: KeyIndex, exclude_ingest: str | None = None) -> DataFrame:
    """The keys in the index, without those of one load."""
    register_key_index(spark, index)
    keys = spark.table(f"`{index.name}`")
    return keys if exclude_ingest is None else keys.where(F.col("ingest_id") != F.lit(exclude_ingest))


def insert_new_indexed(
    spark: SparkSession, incoming: DataFrame, table_path: str, index: KeyIndex, ingest_id: str | None = None
) -> DataFrame:
    """I1 against all history: the rows of ``incoming`` whose key is neither in the index nor in a load that it lacks.

    Bucketed and pending history are asked one after the other, so a union never hides the buckets from the planner. The
    merge hint keeps the first join from broadcasting an index that only looks small."""
    left = insert_new(incoming, indexed_keys(spark, index, ingest_id).hint("merge"))
    pending = pending_loads(spark, table_path, index)
    if ingest_id is not None:
        pending = pending.where(F.col("ingest_id") != F.lit(ingest_id))
    return insert_new(left, _rows_of(spark, table_path, pending))

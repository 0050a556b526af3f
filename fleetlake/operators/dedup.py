"""Existence and first-writer-wins.

The reference looks every incoming row up one by one (or relies on a unique
index with ``on conflict do nothing``). Here both are set operations on the
key ``(vehicle_id, timestamp)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("vehicle_id", "timestamp")


def dedup_first(df: DataFrame, order: list[Column | str] | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row per key, the first by ``order`` (default: file, then line).

    Planned as ``row_number() = 1``: Catalyst inserts a partial
    ``WindowGroupLimit`` before the shuffle, so even a key repeated millions
    of times leaves each map task as a single row (no hot task).
    """
    order = order or [F.col("source_file"), F.col("order_key")]
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == F.lit(1)).drop("_rank")


def insert_new(incoming: DataFrame, existing: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Incoming rows whose key is not in ``existing`` (left anti join).

    Only the key columns of ``existing`` are read. Restrict ``existing`` to
    the partitions the batch can touch (its dates) before calling; dynamic
    partition pruning does not apply to anti joins.
    """
    return incoming.join(existing.select(*key), list(key), "left_anti")


def already_present(incoming: DataFrame, existing: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The rows that would be skipped (left semi join)."""
    return incoming.join(existing.select(*key), list(key), "left_semi")


def mark_existing(incoming: DataFrame, existing: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """I2 in one pass: every incoming row with ``exists`` true/false, so
    inserted and skipped counts come from one join."""
    flags = existing.select(*key).distinct().withColumn("exists", F.lit(True))
    return incoming.join(flags, list(key), "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def insert_counts(flagged: DataFrame) -> DataFrame:
    """``inserted, skipped`` from :func:`mark_existing`."""
    return flagged.agg(
        F.count_if(~F.col("exists")).alias("inserted"),
        F.count_if(F.col("exists")).alias("skipped"),
    )

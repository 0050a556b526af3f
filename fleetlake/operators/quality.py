"""Declarative data tests (D1–D4) as DataFrames of failing rows.

Each check returns the rows that break it (empty = pass), like the SQL a
test framework compiles. ``check_counts`` runs many checks on one relation
in a single aggregate pass instead of one scan per check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    """D1."""
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values seen more than once (NULLs ignored), with their count.
    Partial counts per task before the shuffle, so a hot value is cheap."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .filter(F.col("n_records") > F.lit(1))
    )


def accepted_range(df: DataFrame, column: str, min_value: float, max_value: float) -> DataFrame:
    """D3: ``column < min or column > max``; NULL passes (it is not_null's job)."""
    c = F.col(column)
    return df.filter((c < F.lit(min_value)) | (c > F.lit(max_value)))


def unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key combinations seen more than once. Groups on the columns
    themselves rather than on a concatenated text key, which could collide."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).filter(F.col("n_records") > F.lit(1))


@dataclass(frozen=True)
class Check:
    """One declared test: ``kind`` in not_null / unique / accepted_range / unique_combination."""

    model: str
    kind: str
    columns: tuple[str, ...]
    min_value: float | None = None
    max_value: float | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}({','.join(self.columns)})"

    def failing_rows(self, df: DataFrame) -> DataFrame:
        if self.kind == "not_null":
            return not_null(df, self.columns[0])
        if self.kind == "unique":
            return unique(df, self.columns[0])
        if self.kind == "accepted_range":
            return accepted_range(df, self.columns[0], self.min_value, self.max_value)
        if self.kind == "unique_combination":
            return unique_combination(df, list(self.columns))
        raise ValueError(f"unknown check kind {self.kind}")

    def row_failure(self) -> Column | None:
        """Row-level predicate when the check is one (for the single-pass count)."""
        c = F.col(self.columns[0])
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "accepted_range":
            return (c < F.lit(self.min_value)) | (c > F.lit(self.max_value))
        return None


def check_counts(df: DataFrame, checks: list[Check]) -> DataFrame:
    """``check_index, failures`` for every check on one relation.

    Row-level checks (not_null, accepted_range) share a single aggregate
    pass, unpivoted to one row per check; grouped checks (unique…) add one
    grouped count each."""
    parts: list[DataFrame] = []
    row_idx = [i for i, c in enumerate(checks) if c.row_failure() is not None]
    if row_idx:
        agg = df.agg(*[F.count_if(checks[i].row_failure()).alias(f"c{i}") for i in row_idx])
        parts.append(
            agg.unpivot([], [f"c{i}" for i in row_idx], "check", "failures").select(
                F.substring("check", 2, 10).cast("int").alias("check_index"), "failures"
            )
        )
    for i, c in enumerate(checks):
        if c.row_failure() is None:
            parts.append(
                c.failing_rows(df).agg(F.count(F.lit(1)).alias("failures")).select(
                    F.lit(i).alias("check_index"), "failures"
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

"""Broadcasts behind a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.session import materialise

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluate a summary once, and mark it for broadcast if its rows and bytes are within bounds.

    The summary is written and read again, so it is counted and joined without being computed twice
    and never passes through the driver before its size is known. A larger one is joined by shuffle.
    """
    stored = materialise(df, "summary")
    size = stored.agg(*size_of(stored, F.lit(True))).first()
    return F.broadcast(stored) if fits_broadcast(size["rows"], size["bytes"], max_rows) else stored


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on keys where null equals null; the keys of the left side are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition: Column = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def size_of(df: DataFrame, when: Column) -> list[Column]:
    """Aggregates for rows and text bytes of the rows a condition selects, to check a broadcast."""
    row = F.length(F.to_json(F.struct(*df.columns)))
    return [
        F.count_if(when).alias("rows"),
        F.coalesce(F.sum(F.when(when, row)), F.lit(0)).alias("bytes"),
    ]


def fits_broadcast(rows: int, size: int, max_rows: int = BROADCAST_ROWS) -> bool:
    return rows <= max_rows and size <= BROADCAST_BYTES

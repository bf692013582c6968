"""Data quality per time window; the same expression runs in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.constants import LABEL
from mendframe.functions import scalar as S


def quality_windows(
    df: DataFrame, features: list[str], width: str = "1 day", delay: str = "2 days", label: str = LABEL
) -> DataFrame:
    """Rows, missing share and 0/1 class balance per tumbling window of ``ts``.

    Every value is a mean or a count, so partial aggregates combine and state stays small.
    """
    ones = F.count_if(F.col(label) == 1)
    labelled = F.count(label)
    timed = df.withColumn("ts", F.col("ts").cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark("ts", delay)
    return (
        timed.groupBy(F.window("ts", width).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            S.missing_share(features).alias("missing_pct"),
            F.try_divide(F.least(ones, labelled - ones), labelled).alias("balance_ratio"),
        )
        .select(
            F.col("_w.start").alias("window_start"),
            "n_rows",
            F.round("missing_pct", 6).alias("missing_pct"),
            F.round("balance_ratio", 6).alias("balance_ratio"),
        )
    )

"""Exact random ranks without sorting a whole class in one task.

Rows are ranked by the md5 of their key. The 16-bit prefix of that digest splits every class
into 65,536 even buckets, however large the class is, so a count per bucket already tells
where the k-th row lies; only that one bucket has to be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.constants import ROW_ID
from mendframe.functions.hashing import hash_bucket, hash_hex
from mendframe.operators.sizing import null_safe_join, small_side
from mendframe.session import materialise

PICKED = "_picked"


def mark_smallest(
    df: DataFrame,
    quotas: DataFrame,
    by: list[str],
    seed: int,
    stream: str,
    row_id: str = ROW_ID,
    where: Column | None = None,
) -> DataFrame:
    """Add ``_picked``: true for the ``quota`` rows of smallest digest in each group.

    ``quotas`` holds ``by`` and ``quota``. The table itself is scanned but not shuffled:
    bucket counts and one edge bucket per group are all that moves.
    """
    digest = hash_hex(seed, stream, row_id)
    keep = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    slim = df.filter(keep).select(*by, row_id, digest.alias("_h")).withColumn(
        "_b", hash_bucket(F.col("_h"))
    )
    running = Window.partitionBy(*by).orderBy("_b")
    buckets = slim.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_upto", F.sum("_n").over(running)
    )
    # The bucket with the last picked row of each group, and how many rows to take from it.
    edges = (
        null_safe_join(buckets, quotas, by)
        .filter((F.col("quota") > 0) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .groupBy(*by)
        .agg(
            F.max("_b").alias("_edge"),
            F.min(F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need"),
        )
    )
    edges = small_side(edges)
    inside = null_safe_join(slim, edges, by).filter(F.col("_b") == F.col("_edge"))
    position = F.row_number().over(Window.partitionBy(*by).orderBy("_h", row_id))
    # A quota beyond the group size takes the whole edge bucket.
    cuts = (
        inside.withColumn("_rank", position)
        .filter(F.col("_rank") <= F.col("_need"))
        .groupBy(*by)
        .agg(F.max(F.struct(F.col("_h"), F.col(row_id))).alias("_cut"))
    )
    cuts = small_side(cuts)
    marked = null_safe_join(df.withColumn("_keep", keep), cuts, by, "left")
    picked = F.col("_keep") & (F.struct(digest.alias("_h"), F.col(row_id)) <= F.col("_cut"))
    return marked.withColumn(PICKED, F.coalesce(picked, F.lit(False))).drop("_cut", "_keep")


def pick_smallest(
    df: DataFrame,
    count: int,
    seed: int,
    stream: str,
    row_id: str = ROW_ID,
    where: Column | None = None,
) -> DataFrame:
    """Mark exactly ``count`` rows of the whole table (all of them if it has fewer)."""
    quota = df.sparkSession.range(1).select(
        F.lit(0).alias("_g"), F.lit(count).cast("bigint").alias("quota")
    )
    marked = mark_smallest(df.withColumn("_g", F.lit(0)), quota, ["_g"], seed, stream, row_id, where)
    return marked.drop("_g")


def dense_index(
    df: DataFrame, seed: int, stream: str, row_id: str = ROW_ID, name: str = "_idx", by: str | None = None
) -> DataFrame:
    """Number rows 0..n-1 in digest order: sort within 65,536 buckets plus a running offset.

    With ``by`` every group is numbered by itself, in the order of the stream ``stream/group``.
    """
    if by is None:
        digest, keys = hash_hex(seed, stream, row_id), ["_b"]
        ordered = Window.orderBy("_b")
    else:
        digest = F.md5(F.concat(F.lit(f"{seed}|{stream}/"), F.col(by).cast("string"), F.lit("|"), F.col(row_id).cast("string")))
        keys, ordered = [by, "_b"], Window.partitionBy(by).orderBy("_b")
    hashed = df.withColumn("_h", digest).withColumn("_b", hash_bucket(F.col("_h")))
    offsets = (
        hashed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(ordered))
        .select(*keys, (F.col("_upto") - F.col("_n")).alias("_offset"))
    )
    # At most 65,536 rows per group by construction of the bucket number.
    placed = hashed.join(F.broadcast(offsets) if by is None else offsets, keys)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", row_id))
    return placed.withColumn(name, (position - 1 + F.col("_offset")).cast("bigint")).drop(
        "_h", "_b", "_offset"
    )


def ordered_index(df: DataFrame, order: list[str], name: str = "_idx") -> DataFrame:
    """Number rows 0..n-1 in the order of some columns, which are unique together.

    Rows are range-partitioned and stored, so that the partition numbers stay fixed, and numbered
    within their partition plus an offset.
    """
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    stored = materialise(ranged, "ordered")
    # One row per partition.
    offsets = (
        stored.groupBy("_p")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
        .drop("_n")
    )
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    numbered = stored.join(offsets, "_p").withColumn(name, (place - 1 + F.col("_offset")).cast("bigint"))
    return numbered.drop("_p", "_offset")


def value_codes(values: DataFrame, column: str, name: str = "_code") -> DataFrame:
    """Number distinct values 0..k-1 in sorted order."""
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    return ordered_index(distinct, [column], name).withColumn(name, F.col(name).cast("int"))

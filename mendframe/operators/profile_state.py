"""Column profiles that can be merged and kept up to date.

The state of a table has one row per column and octave of its values: how many rows, their mean and the
second and third sums about it. Nulls, zeros and text each count as an octave of their own. States of
parts of a table add up to the state of the whole, and a repair that changes some columns renews only
their rows; so a version of a table carries its profile along and unchanged columns are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.constants import LABEL
from mendframe.functions import scalar as S

#: Octave numbers of zeros and of text; nulls have none.
ZERO, TEXT = -(1 << 15), (1 << 15) - 1
STATE = "column string, octave int, n bigint, mean double, m2 double, m3 double"


def _octave(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    return F.when(v == 0, ZERO).when(v > 0, size).otherwise(-size).cast("int")


def state_of(df: DataFrame, columns: list[str] | None = None, label: str = LABEL) -> DataFrame:
    """The state of some columns (of the features by default); rows combine in each task."""
    columns = S.feature_columns(df, label) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], STATE)
    numeric = set(S.numeric_features(df, label=""))
    cells = []
    for c in columns:
        v = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        octave = _octave(v) if c in numeric else F.when(F.col(c).isNotNull(), TEXT).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), octave.alias("octave"), v.alias("v")))
    n, spread = F.count(F.lit(1)), F.var_pop("v")
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column", "octave")
        .agg(
            n.alias("n"), F.avg("v").alias("mean"), (spread * n).alias("m2"),
            F.coalesce(F.skewness("v") * F.pow(spread, 1.5) * n, F.when(spread == 0, 0.0)).alias("m3"),
        )
    )


def _about(mean: Column) -> list[Column]:
    """Sums of second and third powers about another mean."""
    gap = F.col("mean") - mean
    return [
        F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"),
        F.sum(F.col("m3") + 3 * gap * F.col("m2") + F.col("n") * gap * gap * gap).alias("m3"),
    ]


def merged(*states: DataFrame) -> DataFrame:
    """The state of tables put together, from theirs."""
    whole = Window.partitionBy("column", "octave")
    rows = reduce(lambda a, b: a.unionByName(b), states)
    rows = rows.withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    return rows.groupBy("column", "octave").agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), *_about(F.col("_mean"))).select("column", "octave", "n", "mean", "m2", "m3")


def renewed(state: DataFrame, df: DataFrame, changed: list[str] | None, label: str = LABEL) -> DataFrame:
    """The state of ``df``, of whose columns only ``changed`` are other than in the table that ``state`` describes.

    ``None`` says that any may have changed, as where rows came or went.
    """
    if changed is None:
        return state_of(df, label=label)
    features = S.feature_columns(df, label)
    kept = [c for c in features if c not in changed]
    return state.where(F.col("column").isin(kept)).unionByName(state_of(df, [c for c in changed if c in features], label))


def profile_of(state: DataFrame) -> DataFrame:
    """``column, n, n_null, n_zero, null_pct, zero_pct, mean, std, skew`` from a state."""
    number = F.col("octave").isNotNull() & (F.col("octave") != TEXT)
    whole = Window.partitionBy("column")
    value = F.when(number, F.col("n"))
    rows = state.withColumn("_mean", F.sum(value * F.col("mean")).over(whole) / F.sum(value).over(whole))
    found = rows.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("octave").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(F.col("octave") == ZERO, F.col("n")).otherwise(0)).alias("n_zero"),
        F.coalesce(F.sum(value), F.lit(0)).alias("n_value"),
        F.first("_mean").alias("mean"),
        *_about(F.col("_mean")),
    )
    k = F.col("n_value").cast("double")
    g1 = F.try_divide(F.col("m3") / k, F.pow(F.col("m2") / k, 1.5)) * F.sqrt(k * (k - 1)) / F.nullif(k - 2, F.lit(0.0))
    return found.select(
        "column", "n", "n_null", "n_zero",
        F.try_divide("n_null", "n").alias("null_pct"),
        F.try_divide("n_zero", "n").alias("zero_pct"),
        "mean",
        F.when(k > 1, F.sqrt(F.col("m2") / (k - 1))).alias("std"),
        F.when((k > 2) & (F.col("m2") > 0), g1).otherwise(0.0).alias("skew"),
    )


def missing_share(state: DataFrame) -> DataFrame:
    """One row: rows of the table, and the mean of the null shares of its columns."""
    return profile_of(state).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.avg("null_pct"), F.lit(0.0)).alias("missing_pct"))

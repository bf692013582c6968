"""Reading, normalising and writing labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe import constants as K
from mendframe.functions import scalar as S
from mendframe.operators.repair import encode_categories


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; empty cells and NaN are null."""
    reader = spark.read.schema(schema).options(header=True, nanValue="NaN", nullValue="")
    return S.nan_to_null(reader.csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Parquet table with its target column renamed to ``label``."""
    df = S.nan_to_null(spark.read.parquet(path))
    return df.withColumnRenamed(target, K.LABEL) if target else df


def normalise_landing(
    df: DataFrame,
    target: str,
    sentinel: str = "?",
    null_as_category: bool = False,
) -> DataFrame:
    """Landed table to labelled table: target to ``label`` codes, sentinels to null, text
    features to codes, rows without a label dropped.

    A missing category stays null by default, so that it is counted as missing later.
    """
    df = S.nan_to_null(df.withColumnRenamed(target, K.LABEL))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in S.feature_columns(df) if isinstance(kinds[c], T.StringType)]
    df = df.withColumns({c: S.sentinel_to_null(c, sentinel) for c in text}) if text else df
    df = df.filter(F.col(K.LABEL).isNotNull()).withColumn(K.LABEL, F.col(K.LABEL).cast("string"))
    df = encode_categories(df, text, null_as_category) if text else df
    return encode_categories(df, [K.LABEL])

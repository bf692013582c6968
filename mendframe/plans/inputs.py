"""Bindings of the test tables to the labelled frames the operators expect.

Each binding is written once as SQL expressions, which Spark and the checking engine
read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Explicit schemas: no job is spent on reading file footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# Events with nulls, zeros, sentinels and an uneven label set by rule on every row.
DIRTY_EVENTS = {
    "_row_id": "event_id",
    "value_n": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END",
    "k": "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)",
    "k_n": "CASE WHEN event_id % 31 = 0 THEN NULL"
    " ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS INT) END",
    "value_z": "CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END",
    "value_s": "CASE WHEN event_id % 3 <> 0 THEN 0.0 ELSE value END",
    "rare": "CASE WHEN event_id < 4 THEN value ELSE NULL END",
    "etype": "CASE WHEN event_id % 13 = 0 THEN '?' ELSE event_type END",
    "label": "CASE WHEN event_id % 10 < 2 THEN 1 ELSE 0 END",
}
EVENT_FEATURES = ["value_n", "k", "k_n", "value_z", "value_s", "rare", "etype"]
EVENT_META = {
    "display_name": "Web activity",
    "domain": "web_activity",
    "published_baseline": 0.8,
    "known_issues": ["zeros stand for missing values", "class imbalance"],
    "domain_rules": {
        "zeros_as_missing": ["value_z", "no_such_column"],
        "log_transform_candidates": ["value_s"],
        "redundant_features": ["etype"],
    },
}
MEDICAL_META = {**EVENT_META, "domain": "medical_events", "display_name": "Medical events"}

DOCS = {
    "_row_id": "doc_id",
    "n_chars": "n_chars",
    "text_len": "CAST(length(text) AS INT)",
    "label": "quality",
    "toxic": "toxic",
}
DOCS_META = {
    "display_name": "Labelled documents",
    "domain": "text_quality",
    "domain_rules": {"log_transform_candidates": ["n_chars"]},
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


DIRTY_EVENTS_SQL = f"dirty AS (SELECT {_select(DIRTY_EVENTS)} FROM events)"
DOCS_SQL = f"docs AS (SELECT {_select(DOCS)} FROM documents JOIN labels USING (doc_id))"
ORDERS_SQL = (
    "ords AS (SELECT o_orderkey AS _row_id, o_totalprice AS price, o_custkey AS custkey,"
    " CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)"
)
#: Columns that the SQL twins write out: as many as the embeddings of the test tables have entries.
SQL_DIMENSIONS = 64


def embedding_columns(dimensions: int) -> list[str]:
    return [f"e{i}" for i in range(dimensions)]



def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        *[F.expr(e).alias(c) for c, e in DIRTY_EVENTS.items()]
    )


def docs_labelled(spark: SparkSession, sf_dir: str, label: str = "label") -> DataFrame:
    """Documents with their quality label; ``label='toxic'`` takes the other label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    columns = {**DOCS, "label": "toxic"} if label == "toxic" else DOCS
    return docs.select(*[F.expr(e).alias(c) for c, e in columns.items() if c != "toxic"])


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_row_id"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("custkey"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )


def embedding_features(spark: SparkSession, sf_dir: str, positive: str) -> DataFrame:
    """One double column per entry of the longest embedding; the label is 1 where the SQL rule ``positive`` holds."""
    embeddings = table(spark, sf_dir, "embeddings")
    longest = embeddings.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    return embeddings.select(
        F.col("vec_id").alias("_row_id"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(embedding_columns(longest))],
        F.expr(f"CASE WHEN {positive} THEN 1 ELSE 0 END").alias("label"),
    )


def embeddings_sql(positive: str) -> str:
    dims = ", ".join(
        f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(embedding_columns(SQL_DIMENSIONS))
    )
    return (
        f"emb AS (SELECT vec_id AS _row_id, {dims},"
        f" CASE WHEN {positive} THEN 1 ELSE 0 END AS label FROM embeddings)"
    )

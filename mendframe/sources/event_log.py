"""JSON event log: one object per line, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.functions.scalar import unix_to_timestamp

EVENT_LOG_SCHEMA = (
    "ts double, level string, msg string, event string, session_id string, attrs map<string,string>"
)


def to_event_lines(df: DataFrame, event: str, ts: str, session_id: str, attrs: list[str]) -> DataFrame:
    """One JSON text per row; the time is in unix seconds with three places."""
    pairs = [x for c in attrs for x in (F.lit(c), F.col(c).cast("string"))]
    seconds = F.round(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000.0, 3)
    return df.select(
        F.to_json(
            F.struct(
                seconds.alias("ts"),
                F.lit("INFO").alias("level"),
                F.lit(event).alias("msg"),
                F.lit(event).alias("event"),
                F.col(session_id).cast("string").alias("session_id"),
                F.create_map(*pairs).alias("attrs"),
            )
        ).alias("value")
    )


def write_event_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return _timed(spark.read.schema(EVENT_LOG_SCHEMA).json(path))


def parse_event_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events of a table of lines (``value``), and the lines that are none, as they came.

    A line is an event if it is a JSON object of the log's fields with at least a time and an event
    name. Works on batches and streams alike.
    """
    read = lines.select("value", F.from_json("value", EVENT_LOG_SCHEMA).alias("e"))
    good = F.col("e.ts").isNotNull() & F.col("e.event").isNotNull()
    return _timed(read.where(good).select("e.*")), read.where(~good).select("value")


def stream_event_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """The log as a stream of events and a stream of its malformed lines."""
    options = {"maxFilesPerTrigger": files_per_batch}
    return parse_event_lines(spark.readStream.options(**options).text(path))


def steps_of(events: DataFrame) -> DataFrame:
    """Step rows, as the live audit reads them, from ``step`` events; ids that were handed out are one JSON list."""
    told = events.where("event = 'step'")
    attrs = F.col("attrs")
    return told.select(
        F.col("session_id").cast("bigint").alias("session_id"),
        attrs["step"].cast("bigint").alias("step"),
        "ts",
        attrs["action"].alias("action"),
        attrs["rec_id"].alias("rec_id"),
        F.from_json(attrs["issued"], "array<string>").alias("issued"),
        *[attrs[c].cast("double").alias(c) for c in ("accuracy_after", "target_accuracy")],
    )


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", unix_to_timestamp("ts"))

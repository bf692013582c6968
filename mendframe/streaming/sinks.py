"""Running a stream to its end into the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.session import scratch_path


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which processors with timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into parquet files and read them back."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    with state_store(spark):
        (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Process all available input; keep the latest row of each key.

    Every micro-batch overwrites its own folder, so a repeated batch leaves no second copy.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return latest_by(spark.read.parquet(out), keys, "batch").drop("batch")


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest snapshot of each key from an append-only table; combined before the shuffle."""
    values = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v"))
    return latest.select(*keys, "_v.*")

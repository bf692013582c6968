"""Helpers the operators share: table access, samples of bounded size, shared-folder paths."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 2.0**63


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_unit(*keys: Column | str, seed: int = 0) -> Column:
    """A draw in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 1) / F.lit(UNIT)


def hash_sample(df: DataFrame, bound: int, *keys: str, seed: int = 0) -> DataFrame:
    """About ``bound`` rows chosen by the hash of their keys (all of them if there are fewer).

    The share is taken from a count, so no task sorts or collects more than its part; the size
    is binomial around ``bound``, never more than a few per cent above it for bounds in the thousands.
    """
    n = df.count()
    return df if n <= bound else df.where(hash_unit(*keys, seed=seed) < bound / n)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % parts


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand so many rows at a time to Python, which bounds what long texts take there."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Hands memory that this process has freed back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``: a worker, which Spark keeps, does not keep what its tasks have freed."""

    def told(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return told

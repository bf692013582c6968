"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only on a local master, as in tests, a temporary folder stands in for a missing setting. Tables
    written below it are read by lazy results, so they stay until the caller's results are stored;
    give the folder a retention rule, or call ``clear_scratch`` then.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="mendframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths handed out in this process, by application: what ``clear_scratch`` may remove.
_handed: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _handed.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession, since: int = 0) -> int:
    """Removes the tables this application has written below the shared folder; how many.

    Call it when all results that read them are stored. ``since`` keeps the first ones
    (``scratch_mark`` tells how many there are at a moment).
    """
    paths = _handed.get(spark.sparkContext.applicationId, [])
    gone, kept = paths[since:], paths[:since]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    _handed[spark.sparkContext.applicationId] = kept
    return len(gone)


def scratch_mark(spark: SparkSession) -> int:
    return len(_handed.get(spark.sparkContext.applicationId, []))


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

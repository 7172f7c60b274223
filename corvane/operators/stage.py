"""Tables that several parts of a run read: made once, written to the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir()


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted with the others."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again: what reads it twice computes it once and prunes its columns."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Deletes the tables written so far; frames that read them are of no use afterwards."""
    while _written:
        sc, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may be gone, and the folder with it
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


atexit.register(clear)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt over all of them before costly row-wise work."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)

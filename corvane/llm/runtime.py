"""Session helpers shared by the operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import stage


def scratch(spark: SparkSession) -> str:
    """The folder that all machines share: the session's ``spark.checkpoint.dir``."""
    return stage.folder(spark)


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the program ends."""
    return stage.place(spark, name)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of texts that a Python worker gets at once.
BATCH_BYTES = 16 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, after Arrow batches of this session are bounded by bytes as well as by rows."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it with its lineage cut."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing reads any more, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Narrow rows that one task may well take: small tables in fewer partitions need fewer files and no exchange.
TASK_ROWS = 200_000


def packed(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``cut``, then as many partitions as the counted rows need.

    A table of one partition is grouped and joined where it is; a larger one
    keeps partitions in proportion to its rows.
    """
    df = cut(df)
    return df.coalesce(max(1, -(-df.count() // rows)))  # coalesce never adds partitions

"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a join may send to the driver and to every task.
FEW = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset and all runs on one machine a folder is made once and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stemma-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/stemma/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which there are n at most, as a side of a join: sent to all tasks if they are few, else both sides move by key.
    Spark's own choice goes by the size of compressed files, and holds many times as much on the driver."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")

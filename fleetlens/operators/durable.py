"""Tables that survive lost executors: written to the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, whose executors share its disk, gets a folder of its own where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, *, by: str | None = None, at: str | None = None) -> DataFrame:
    """df written as Parquet (a folder for each value of `by`) and read again."""
    target = at or new_path(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a path, wherever Spark keeps it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def exists(spark: SparkSession, path: str) -> bool:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)

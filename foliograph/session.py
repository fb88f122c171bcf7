"""What a session's cluster offers: the shared folder, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir.

    Where the session names none a temporary folder is taken, but only on a local master, whose tasks run on this machine.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliograph-"))
    return context.getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared one that goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)  # what isn't there can't be marked
    files.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df computed once and stored by columns in the shared folder, for tables of which later steps read some columns."""
    path = new_folder(df.sparkSession, "table") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Pages as a stream: state by page as revisions arrive, with a checkpoint in the given folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut


def arriving(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def progress(stream: DataFrame, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows, issues and the last change of each page in windows of an hour; state of closed windows goes."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, "1 hour"), "page_id").agg(F.count("*").alias("n"), F.count_if(F.col("suppressed")).alias("issues"), F.max(time_col).alias("last"))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what has arrived and ends."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()


def latest(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Keeps the newest row of each page and element in a table, batch by batch.

    A batch is merged with the rows of its own pages, and only their folders are written anew; a batch that is
    played again changes nothing.
    """

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("page_id", "pos").agg(F.max_by(F.struct(*rows.columns), "ts").alias("r")).select("r.*")

    def merge(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        try:
            held = own.read.schema(batch.schema).parquet(out).select(*batch.columns)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            held = batch.limit(0)
        pages = batch.select("page_id").distinct()
        merged = cut(newest(held.join(pages, "page_id", "left_semi").select(*batch.columns).unionByName(batch)))  # stored before what it was read from goes
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page_id").parquet(out)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

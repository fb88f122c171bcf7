"""The newest row of each page and element as a table of versions: readers see a batch whole or not at all.

Pages are dealt by a hash into a fixed number of buckets. A batch writes its buckets anew beside the old ones, and then a list
that says which version of each bucket counts; the list is renamed into its place, which is the moment at which the batch is seen.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _lists(spark: SparkSession, out: str) -> list[int]:
    """The batches that have a list, in order."""
    at, fs = _files(spark, f"{out}/lists")
    return sorted(int(n[:-5]) for f in (fs.listStatus(at) if fs.exists(at) else []) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit())


def _versions(spark: SparkSession, out: str, before: int | None = None) -> dict[int, int]:
    """The batch that wrote each bucket, by the last list, or the last one before a batch."""
    known = [k for k in _lists(spark, out) if before is None or k < before]
    if not known:
        return {}
    said = spark.read.text(f"{out}/lists/{known[-1]}.json", wholetext=True).first()[0]
    return {int(b): v for b, v in json.loads(said).items()}


def _point(spark: SparkSession, out: str, number: int, versions: dict[int, int]) -> None:
    at, fs = _files(spark, f"{out}/lists/{number}.json")
    new, _ = _files(spark, f"{out}/lists/.{number}.tmp")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
    stream.close()
    if fs.exists(at):  # the batch is played again; its rows are the same
        fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"{at} could not be put in place")


def _read(spark: SparkSession, out: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{out}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_id", "pos").agg(F.max_by(F.struct(*rows.columns), "ts").alias("r")).select("r.*")


def merge(batch: DataFrame, number: int, out: str, buckets: int = BUCKETS) -> None:
    """Takes a batch (page_id, pos, ts, ...) in; a batch that is played again replaces what it wrote before."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")
    batch = cut(batch)
    touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # no more than there are buckets
    if not touched:
        return
    before = _versions(spark, out, number)
    held = _read(spark, out, {b: v for b, v in before.items() if b in touched})
    rows = batch if held is None else held.select(*batch.columns).unionByName(batch)
    newest(rows).withColumn("bucket", bucket).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/rows/version={number}")
    _point(spark, out, number, before | dict.fromkeys(touched, number))


def keep(stream: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Works off what has arrived and ends."""
    stream.writeStream.foreachBatch(lambda b, k: merge(b, k, out, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, out: str, schema: str | None = None) -> DataFrame:
    """The table as the last list has it; with a schema an empty table if there is none yet."""
    found = _read(spark, out, _versions(spark, out))
    if found is None:
        if schema is None:
            raise FileNotFoundError(f"there is no table in {out}")
        return spark.createDataFrame([], schema)
    return found


def vacuum(spark: SparkSession, out: str, keep_lists: int = 2) -> list[int]:
    """Removes lists but for the last few, and versions that none of those names; the numbers of the versions that went."""
    known = _lists(spark, out)
    last = known[-keep_lists:]
    named = {v for k in last for v in _versions(spark, out, k + 1).values()}
    at, fs = _files(spark, f"{out}/rows")
    there = sorted(int(f.getPath().getName().split("=")[1]) for f in (fs.listStatus(at) if fs.exists(at) else []))
    gone = [v for v in there if v not in named and v < known[-1]] if known else []  # a later version is a batch that isn't ended
    for k in known[:-keep_lists]:
        fs.delete(_files(spark, f"{out}/lists/{k}.json")[0], False)
    for v in gone:
        fs.delete(_files(spark, f"{out}/rows/version={v}")[0], True)
    return gone

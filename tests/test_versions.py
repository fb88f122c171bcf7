"""A table of versions from a stream: the newest rows, batches seen whole, replays and old versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliograph.streaming import versions as V

KIND = "page_id bigint, pos int, ts bigint, type string"


def batches(spark, n=5):
    rnd = random.Random(2)
    return [[(rnd.randrange(12), rnd.randrange(5), b * 1000 + i, f"t{b}_{i}") for i in range(rnd.choice([1, 30]))] for b in range(n)]


def held(spark, out):
    return {(r.page_id, r.pos): r.type for r in V.read(spark, out).collect()}


def want(parts):
    state = {}
    for _, row in sorted((r[2], r) for part in parts for r in part):
        state[row[0], row[1]] = row[3]
    return state


def test_batches_and_replays(spark, tmp_path):
    out, parts = str(tmp_path / "t"), batches(spark)
    assert V.read(spark, out, KIND).count() == 0
    with pytest.raises(FileNotFoundError):
        V.read(spark, out)
    for k, part in enumerate(parts):
        V.merge(spark.createDataFrame(part, KIND), k, out, 4)
        assert held(spark, out) == want(parts[: k + 1])
        V.merge(spark.createDataFrame(part, KIND), k, out, 4)  # played again
        assert held(spark, out) == want(parts[: k + 1])
    V.merge(spark.createDataFrame([], KIND), len(parts), out, 4)
    assert held(spark, out) == want(parts) and V.read(spark, out).count() == len(want(parts))


def test_half_a_batch_is_not_seen(spark, tmp_path, monkeypatch):
    """The driver dies after the rows and before the list: readers still have the batch before, and the replay mends it."""
    out, parts = str(tmp_path / "t"), batches(spark, 3)
    V.merge(spark.createDataFrame(parts[1], KIND), 0, out, 4)
    before = held(spark, out)
    with monkeypatch.context() as m:
        m.setattr(V, "_point", lambda *a: (_ for _ in ()).throw(OSError("dead")))
        with pytest.raises(OSError):
            V.merge(spark.createDataFrame(parts[0], KIND), 1, out, 4)
    assert held(spark, out) == before and (tmp_path / "t/rows/version=1").exists()
    assert V.vacuum(spark, out) == []  # what isn't ended stays
    V.merge(spark.createDataFrame(parts[0], KIND), 1, out, 4)
    assert held(spark, out) == want([parts[1], parts[0]])


def test_old_versions_go(spark, tmp_path):
    out = str(tmp_path / "t")
    every = [[(p, 0, b, f"t{b}") for p in range(20)] for b in range(5)]  # each batch writes all buckets anew
    for k, part in enumerate(every):
        V.merge(spark.createDataFrame(part, KIND), k, out, 4)
    assert V.vacuum(spark, out) == [0, 1, 2] and held(spark, out) == want(every)
    assert sorted(p.name for p in (tmp_path / "t/lists").glob("*.json")) == ["3.json", "4.json"]
    assert set(json.loads((tmp_path / "t/lists/4.json").read_text()).values()) == {4}


def test_stream_into_versions(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 5).alias("page_id"), (F.col("id") % 20).cast("int").alias("pos"), F.col("id").alias("ts"), F.concat(F.lit("t"), "id").alias("type"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    V.keep(stream, str(tmp_path / "out"), str(tmp_path / "c"), 3)
    got = {(r.page_id, r.pos): r.ts for r in V.read(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.page_id, r.pos): r.ts for r in rows.groupBy("page_id", "pos").agg(F.max("ts").alias("ts")).collect()}

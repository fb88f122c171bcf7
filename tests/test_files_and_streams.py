import json

from pyspark.sql import functions as F

from foliograph.sources import store
from foliograph.streaming import pages as live


def element(i, kind="text"):
    return {"id": f"e{i}", "type": kind, "x": 1.0 * i, "y": 2.0, "width": 10.0, "height": 5.0, "zIndex": i, "metadata": {"ownedBy": "e1"}, "style": {"fontSize": 12.0}}


def test_pages_are_read_in_order_and_written_by_page(spark, tmp_path):
    for n in (2, 10, 1):
        (tmp_path / f"page_{n}.json").write_text(json.dumps({"version": "1", "slide": {"width": 960, "height": 540}, "elements": [element(i) for i in range(n)]}, indent=1))
    assert [r["page_no"] for r in store.read_pages(spark, str(tmp_path)).collect()] == [1, 2, 10]
    e = store.read_elements(spark, str(tmp_path))
    assert e.count() == 13 and e.where("page_no = 10 AND pos = 9").first()["metadata"]["ownedBy"] == "e1"
    out = str(tmp_path / "table")
    store.write_elements(e, out)
    store.write_elements(e.where("page_no = 2 AND pos = 0"), out)
    counts = {r["page_no"]: r["count"] for r in spark.read.parquet(out).groupBy("page_no").count().collect()}
    assert counts == {1: 1, 2: 1, 10: 10}


def test_images_by_extension(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert sorted(r["name"] for r in store.read_images(spark, str(tmp_path)).collect()) == ["a.png", "b.JPG"]


def test_stream_of_pages(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 5).alias("page_id"), (F.col("id") % 20).cast("int").alias("pos"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 7 == 0).alias("suppressed"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = live.arriving(spark, str(tmp_path / "in"), rows.schema, 1)
    live.run_available(live.progress(stream, late="10 hours"), str(tmp_path / "out"), str(tmp_path / "c1"))
    live.latest(spark, live.arriving(spark, str(tmp_path / "in"), rows.schema, 1), str(tmp_path / "state"), str(tmp_path / "c2"))
    state = spark.read.parquet(str(tmp_path / "state"))
    assert state.count() == rows.select("page_id", "pos").distinct().count()
    assert state.agg(F.max("ts")).first()[0] == rows.agg(F.max("ts")).first()[0]


def test_repaired_urls_keep_other_columns(spark):
    e = spark.createDataFrame([(1, "/old/a.png?v=2", "n", "u"), (2, "/old/c.png", "n", "u"), (3, None, "n", "u")], "id int, src string, kept_name string, url string")
    kept = spark.createDataFrame([("a.png", "/new/a.png"), ("b.png", "/new/b.png")], "name string, url string")
    got = {r.id: tuple(r)[1:] for r in store.repaired_urls(e, kept).select("id", "src", "kept_name", "url").collect()}
    assert got == {1: ("/new/a.png", "n", "u"), 2: ("/old/c.png", "n", "u"), 3: (None, "n", "u")}

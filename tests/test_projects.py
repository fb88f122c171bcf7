"""Project folders as a data source, and projects as keyed state."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from foliograph.sources import projects as P
from foliograph.streaming import projects as L


def pages(spark, rows):
    return spark.createDataFrame(rows, P.SCHEMA)


def doc(n):
    return json.dumps({"elements": [{"id": f"e{k}", "text": "äß"} for k in range(n)]}, ensure_ascii=False)


def files(root):
    return sorted(f"{os.path.relpath(d, root)}/{n}" for d, _, names in os.walk(root) for n in names)


def test_pages_go_and_come_back(spark, tmp_path):
    root = str(tmp_path / "out")
    assert P.read_projects(spark, root).count() == 0
    P.write_projects(pages(spark, [("aa", 1, doc(1)), ("aa", 10, doc(2)), ("aa", 2, doc(3)), ("b0", 1, doc(0))]), root)
    (tmp_path / "out/aa/slides/notes.txt").write_text("x")
    (tmp_path / "out/zz").mkdir()
    got = [tuple(r) for r in P.read_projects(spark, f"file://{root}").collect()]
    assert got == [("aa", 1, doc(1)), ("aa", 2, doc(3)), ("aa", 10, doc(2)), ("b0", 1, doc(0))]
    P.write_projects(pages(spark, [("aa", 2, doc(9))]), root)
    assert {(r.project, r.page): r.document for r in P.read_projects(spark, root).collect()} == {("aa", 1): doc(1), ("aa", 2): doc(9), ("aa", 10): doc(2), ("b0", 1): doc(0)}
    assert not [f for f in files(root) if f.endswith((".tmp", ".old"))]


def test_a_partition_for_each_project_and_conditions_first(spark, tmp_path):
    root = str(tmp_path)
    P.write_projects(pages(spark, [(f"{k:02x}", n, doc(n)) for k in range(6) for n in range(1, 4)]), root)
    df = P.read_projects(spark, root)
    assert df.rdd.getNumPartitions() == 6
    one = df.where("project = '03' AND page = 2")
    assert [tuple(r) for r in one.collect()] == [("03", 2, doc(2))] and one.rdd.getNumPartitions() == 1
    assert df.where("project IN ('00', '../../etc', 'nope')").count() == 3
    # a user's schema decides what is read: without the document no file is opened
    os.chmod(tmp_path / "03/slides/page_1.json", 0)
    spark.dataSource.register(P.ProjectSource)
    names = spark.read.format(P.FORMAT).schema("page int, project string").load(root)
    assert names.count() == 18 and names.columns == ["page", "project"]
    with pytest.raises(Exception, match="pages have no"):
        spark.read.format(P.FORMAT).schema("weight int").load(root).collect()


@pytest.mark.parametrize("bad", [("aa", 0, "{}"), ("aa", 5, "{broken"), ("../x", 1, "{}"), ("aa", 5, None)])
def test_a_failed_task_leaves_the_old_pages(spark, tmp_path, bad):
    root = str(tmp_path)
    P.write_projects(pages(spark, [("aa", 1, doc(1)), ("bb", 1, doc(1))]), root)
    before = files(root)
    with pytest.raises(Exception):  # noqa: B017
        P.write_projects(pages(spark, [("aa", 1, doc(7)), ("bb", 1, doc(7)), ("cc", 1, doc(7)), bad]).repartition(4), root)
    assert [f for f in files(root) if f.startswith(("aa", "bb"))] == before and not [f for f in files(root) if f.endswith((".tmp", ".old"))]
    assert {r.document for r in P.read_projects(spark, root).collect()} == {doc(1)}


def test_a_killed_writer_leaves_the_old_pages(spark, tmp_path):
    """The worker dies in the middle of its rows, after it has written some of them."""
    root = str(tmp_path)
    P.write_projects(pages(spark, [("aa", 1, doc(1))]), root)

    def rows(batches):
        for batch in batches:
            yield batch
            os._exit(1)

    dying = pages(spark, [("aa", 1, doc(5)), ("aa", 2, doc(5))]).coalesce(1).mapInArrow(rows, P.SCHEMA)
    with pytest.raises(Exception):  # noqa: B017
        P.write_projects(dying, root)
    assert [tuple(r) for r in P.read_projects(spark, root).collect()] == [("aa", 1, doc(1))]


def test_commit_gives_back_what_it_can_not_finish(tmp_path):
    schema = P.StructType().add("project", StringType()).add("page", IntegerType()).add("document", StringType())
    w = P.PageWriter(str(tmp_path), schema)
    w.commit([w.write(iter([P.Row(project="aa", page=1, document=doc(1))]))])
    w = P.PageWriter(str(tmp_path), schema)
    m = w.write(iter([P.Row(project="aa", page=n, document=doc(8)) for n in (1, 2, 3)]))
    os.remove(m.files[-1][0])  # the last one can't be renamed
    with pytest.raises(FileNotFoundError):
        w.commit([None, m])
    assert files(str(tmp_path)) == ["aa/slides/page_1.json"] and (tmp_path / "aa/slides/page_1.json").read_text() == doc(1)


# state

EVENTS = "project bigint, kind string, id bigint, value int, s bigint"


def events(seed=1, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.choice(["image", "image", "approve", "stage", "accept", "discard"])
        out.append((rnd.randrange(4), kind, i, rnd.randrange(1, 9), 1_700_000_000 + i * 20))
    return out


def run(spark, tmp_path, batches, abandoned=10**12, late="7 days"):
    """The last state of each project after the batches, one file each."""
    at = tmp_path / "in"
    schema = spark.createDataFrame([], EVENTS).select("project", "kind", "id", "value", F.timestamp_seconds("s").alias("ts")).schema
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, EVENTS).select("project", "kind", "id", "value", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(at))
        stream = spark.readStream.schema(schema).parquet(str(at))
        L.kept(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), late, abandoned)
        assert k >= 0
    rows = spark.read.parquet(str(tmp_path / "out"))
    return {r.project: r for r in L.newest(rows).collect()}


def ends(rows):
    """(images, approved, version) of each project, whatever the order."""
    out = {}
    for p in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == p]
        pages_ = sorted({r[3] for r in mine if r[1] == "approve"})
        out[p] = (len({r[2] for r in mine if r[1] == "image"}), ",".join(map(str, pages_)), max((r[3] for r in mine if r[1] == "accept"), default=0))
    return out


def test_state_over_batches_repeats_and_late_events(spark, tmp_path):
    rows = events()
    want = ends(rows)
    rnd = random.Random(3)
    shuffled = rnd.sample(rows, len(rows))
    for k, batches in enumerate(([rows], [rows[:100], rows[100:200], rows[200:]], [shuffled[:150], shuffled[150:] + shuffled[:40]])):
        got = run(spark, tmp_path / str(k), batches)
        assert {p: (r.images, r.approved, r.version) for p, r in got.items()} == want


def test_a_batch_that_is_played_again_changes_nothing(spark, tmp_path):
    rows = events(5, 60)
    run(spark, tmp_path, [rows[:30], rows[30:]])
    commits = sorted((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver had died before it could note that the batch was done
    for crc in (tmp_path / "checkpoint/commits").glob(".*.crc"):
        crc.unlink()
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    L.kept(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "7 days", 10**12)
    got = {r.project: r for r in L.newest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert {p: (r.images, r.approved, r.version) for p, r in got.items()} == ends(rows)


def test_abandoned_stages_are_dropped(spark, tmp_path):
    t = 1_700_000_000
    first = [(1, "stage", 1, 3, t), (2, "stage", 2, 4, t), (3, "accept", 3, 5, t), (3, "stage", 4, 5, t + 1), (4, "stage", 5, 2, t), (4, "discard", 6, 2, t + 5)]
    got = run(spark, tmp_path / "a", [first], 60_000, "1 hour")
    assert {p: r.staged for p, r in got.items()} == {1: 3, 2: 4, 3: None, 4: None}
    later = [(2, "accept", 7, 4, t + 30), (9, "image", 8, 1, t + 90_000), (9, "image", 9, 1, t + 90_001)]
    got = run(spark, tmp_path / "b", [first, later, [(9, "image", 10, 1, t + 90_002)]], 60_000, "1 hour")
    assert got[1].staged is None and got[1].version == 0  # by its timer
    assert got[2].version == 4 and got[2].staged is None and got[9].images == 3


def test_very_many_projects_share_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "MOST", 3)
    root = str(tmp_path)
    P.write_projects(pages(spark, [(f"{k:02x}", n, doc(n)) for k in range(8) for n in (1, 2)]), root)
    parts = P.PageReader(root, spark.read.format(P.FORMAT).load(root).schema).partitions()
    assert [p.names for p in parts] == [["00", "01", "02"], ["03", "04", "05"], ["06", "07"]]
    assert P.read_projects(spark, root).count() == 16

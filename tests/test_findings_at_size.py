"""Steps that go through a batch of pages at a time give what they gave page by page, however batches fall."""

import math
import random
from fractions import Fraction

import pandas as pd

from foliograph.operators import palette as C
from foliograph.operators import raster as P
from foliograph.sources.providers import WordBoxes, parts


def test_clusters_take_no_jobs_and_any_batches(spark):
    """Each step of each try was a job of its own that stored all centres."""
    rnd = random.Random(3)
    rows = [(p, rnd.randrange(1 << 24), rnd.randrange(1, 900)) for p in range(12) for _ in range(1 if p == 5 else rnd.randrange(2, 40))]
    found = spark.createDataFrame([*rows, (None, 5, 1), (40, 5, 0)], "page_id bigint, rgb bigint, n bigint")
    spark.sparkContext.setJobGroup("clusters", "")
    made = C.clusters(found)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("clusters")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
    whole = sorted(made.collect())
    assert {r.page_id: sum(x.n for x in whole if x.page_id == r.page_id) for r in whole} == {p: sum(n for q, _, n in rows if q == p) for p in range(12)}
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(C.clusters(found).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def _plain_rings(pixels, rounds):
    """pixels: {place: level or None}; means of whole billionths, halves upwards."""
    now = {at: None if v is None else v * 10**9 for at, v in pixels.items()}
    for _ in range(rounds):
        before = dict(now)
        for (x, y), v in before.items():
            near = [w for i in (-1, 0, 1) for j in (-1, 0, 1) if (w := before.get((x + i, y + j))) is not None]
            if v is None and near:
                now[x, y] = math.floor(Fraction(sum(near), len(near)) + Fraction(1, 2))
    return {at: None if v is None else v / 10**9 for at, v in now.items()}


def test_rings_of_holes_without_joins(spark):
    """Each ring copied all pixels nine times, and shuffled and joined them."""
    rnd = random.Random(8)
    pages = {p: {(x, y): None if 1 < x < 10 and 1 < y < 8 or rnd.random() < 0.2 else rnd.randrange(256) for x in range(12) for y in range(9) if rnd.random() < 0.95} for p in range(7)}
    pages[3] = {(x, y): None for x in range(4) for y in range(4)}  # nothing known
    rows = [(p, x, y, v) for p, held in pages.items() for (x, y), v in held.items()]
    df = spark.createDataFrame([*rows, (None, 0, 0, 7), (None, 0, 1, None)], "page_id bigint, px int, py int, v int")
    made = P.inpainted(df, "v IS NULL")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    want = {(p, *at, x) for p, held in pages.items() for at, x in _plain_rings(held, 3).items()} | {(None, 0, 0, 7.0), (None, 0, 1, None)}
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (most, "7", "108"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = made.collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        assert {tuple(r) for r in got} == want and len(got) == len(want), size
    assert P.inpainted(df.where("false"), "v IS NULL").count() == 0


def test_words_are_made_of_a_few_letters_at_a_time():
    """A recogniser got four million letters, and made objects of all their words before it handed on the first."""
    rows = pd.DataFrame({"page_id": range(3000), "pos": 0, "text": [f"w{k} " * 200 for k in range(3000)], "x1": 40.0})
    got = list(parts(rows))
    assert max(p["text"].str.len().sum() for p in got) <= 1 << 18 and pd.concat(got, ignore_index=True).equals(rows)
    few = pd.DataFrame({"page_id": [5, 6, 7, 8], "pos": [1, 2, 3, 4], "text": ["  a b  a ", "", None, "x\ty"], "x1": [40.0, 0.0, 1.0, 340.0]})
    made = WordBoxes().run(few)
    assert list(made.itertuples(index=False, name=None)) == [(5, 1, 2, "a", 58.0, 0.8), (5, 1, 3, "b", 67.0, 0.8), (5, 1, 5, "a", 85.0, 0.8), (8, 4, 0, "x\ty", 340.0, 0.8)]
    assert made.dtypes[["pos", "nth"]].tolist() == ["int32", "int32"] and WordBoxes().run(few[1:2]).empty

"""Properties of the box algebra and of the page operators."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.functions import geometry as G
from foliograph.functions import scalars as S
from foliograph.operators import raster as P
from foliograph.operators import relations as R
from foliograph.operators import sequence as Q

edge = st.integers(0, 60)
boxes = st.lists(st.tuples(edge, edge, st.integers(1, 40), st.integers(1, 40)), min_size=2, max_size=14)


def frame(spark, bs):
    return spark.createDataFrame([(1, i, "image", float(x), float(y), float(x + w), float(y + h), 0.5) for i, (x, y, w, h) in enumerate(bs)], "page_id int, pos int, type string, x1 double, y1 double, x2 double, y2 double, confidence double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(boxes)
def test_pairs(spark, bs):
    p = R.pairs(frame(spark, bs))
    a, b = G.box("a_"), G.box("b_")
    rows = p.select("a_pos", "b_pos", G.intersects(a, b).alias("meets"), G.iou(a, b).alias("iou"), G.iou(b, a).alias("uoi"), G.intersection(a, b).alias("common"), G.area(a).alias("area")).collect()
    assert len(rows) == len(bs) * (len(bs) - 1) // 2
    for r in rows:
        assert r["iou"] == r["uoi"] and 0 <= r["iou"] <= 1 and r["common"] <= r["area"] and r["meets"] == (r["common"] > 0)
    grid = {(r["a_pos"], r["b_pos"]) for r in R.overlapping(frame(spark, bs), frame(spark, bs), 16).where("a_pos < b_pos").collect()}
    assert grid == {(r["a_pos"], r["b_pos"]) for r in rows if r["meets"]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(boxes)
def test_greedy_selection(spark, bs):
    got = sorted(r["pos"] for r in Q.select_greedily(frame(spark, bs), ["pos"], lambda a, b: Q.overlap_of(a, b) > 0, ["x1", "y1", "x2", "y2"]).collect())
    kept = []
    for i, (x, y, w, h) in enumerate(bs):
        if all(min(x + w, a + c) <= max(x, a) or min(y + h, b + d) <= max(y, b) for a, b, c, d in (bs[k] for k in kept)):
            kept.append(i)
    assert got == kept


def test_components_of_a_ring(spark):
    ring = [(1, x, y, 200 if x in (1, 4) or y in (1, 4) else 0) for x in range(1, 5) for y in range(1, 5)] + [(1, 7, 7, 200)]
    df = spark.createDataFrame(ring, "page_id int, px int, py int, v int")
    labels = {(r["px"], r["py"]): r["label"] for r in P.components(df, F.col("v") > 100).collect()}
    assert len(set(labels.values())) == 2 and labels[(1, 1)] == labels[(4, 4)] != labels[(7, 7)]


def test_scalars(spark):
    df = spark.createDataFrame([("Straße 　x",), ("12.5%",), ("",), (None,)], "t string")
    got = df.select(S.duplicate_key(F.col("t")).alias("k"), S.probability(F.col("t")).alias("p"), S.font_weight(F.lit("560")).alias("w"), S.asset_name(F.lit("/a/../b.png")).alias("n")).collect()
    assert [r["k"] for r in got] == ["strassex", "12.5%", None, None] and got[1]["p"] == 0.125 and got[2]["p"] == 0.5 and got[0]["w"] == 600 and got[0]["n"] is None

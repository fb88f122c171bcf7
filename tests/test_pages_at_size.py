"""What pages cost: runs instead of pixels, a picture drawn once a round, rows handed on together."""

import os
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliograph import plans
from foliograph.operators import edges as E
from foliograph.operators import stats as T
from foliograph.operators.images import from_png, to_png
from foliograph.plans import images as Q
from foliograph.sources import pictures as S

SF = "/root/testdata/sf0.001"


def masks():
    rng = np.random.default_rng(7)
    yield from (rng.random((h, w)) < p for h, w in ((1, 1), (1, 9), (9, 1), (13, 17), (40, 30)) for p in (0.0, 0.3, 0.6, 1.0))


def test_components_of_runs_as_of_labels():
    for m in masks():
        lab = E.labels(m)
        got = E.components(m)
        assert E.extents(m) == [c[:5] for c in got] and len(got) == lab.max()
        for k, (x1, y1, x2, y2, n, places) in enumerate(got):
            y, x = np.nonzero(lab == k + 1)
            assert (x.min(), y.min(), x.max() + 1, y.max() + 1, len(x)) == (x1, y1, x2, y2, n) and (lab.ravel()[places] == k + 1).all()


def test_dilated_as_counted():
    for m in masks():
        for reach in (1, 2, 6):
            p = np.pad(m, reach)
            plain = np.array([[p[y : y + 2 * reach + 1, x : x + 2 * reach + 1].any() for x in range(m.shape[1])] for y in range(m.shape[0])])
            assert (E.dilated(m, reach) == plain).all()


def test_corners_of_outlines_are_those_of_borders():
    for m in masks():
        begin, outermost, x, y, corner = E.outlines(m)
        for k, (points, o) in enumerate(E.borders(m)):
            at = slice(begin[k], begin[k + 1])
            assert o == outermost[k] and E.corners(points) == list(zip(x[at][corner[at]].tolist(), y[at][corner[at]].tolist(), strict=True))


def test_statistics_by_counts_as_from_values():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    image[:3] = image[-3:] = image[:, :3] = image[:, -3:] = 255
    elements = [{"element_id": k, "type": "image", "x1": x, "y1": y, "x2": x + w, "y2": y + h} for k, (x, y, w, h) in enumerate(((-4, 2, 20, 9), (30, 20, 50, 50), (5, 5, 0, 4), (70, 5, 5, 5), (0, 0, 3, 3)))]
    got = T.stats_of(image, elements)
    for k, e in enumerate(elements):
        x1, y1, x2, y2 = max(0, e["x1"]), max(0, e["y1"]), min(60, e["x2"]), min(40, e["y2"])
        box = image[y1 : max(y1, y2), x1 : max(x1, x2)].astype(int)
        v = box[np.abs(box - 255).max(2, initial=0) >= 5]
        middle = np.median(v, axis=0) if len(v) else np.array([255.0] * 3)
        want = len(v), np.abs(middle - 255).max(), (np.abs(v - middle).max(1) <= 12).mean() if len(v) else 0, v.std(0).max() if len(v) else 0
        assert np.allclose([got[n][k] for n in ("pixels", "delta", "alike", "spread")], want)
    assert all(v == [] for v in T.stats_of(image, []).values())


def test_images_share_a_batch(spark):
    """Each image was a batch of its own."""
    ran = []
    images = spark.createDataFrame([(k, 4, 3, bytes(12)) for k in range(9)], "page_id bigint, width int, height int, data binary")
    with mock.patch.object(type(images), "mapInArrow", lambda self, run, schema: ran.append(run)):
        S.per_image(images, [("n", pa.int64())], lambda image: {"n": [image.size]})
    made = list(ran[0](iter(images.toArrow().to_batches())))
    assert [len(b) for b in made] == [9] and made[0].column(1).to_pylist() == [12] * 9


def test_plain_as_arrow_says():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.string())]))
    column = pa.array([[{"a": 1, "b": "x"}], None, [], [{"a": None, "b": None}, {"a": 2, "b": "y"}]], kind)
    for c in (column, column.slice(1), column.slice(3), pa.array([[None]], kind), pa.array([1, None])):
        assert S.plain(c) == c.to_pylist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_statistics_are_not_joined(spark):
    for name in ("fil13_measured_solid", "fil14_measured_icon"):
        assert "Join" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_round_draws_once(spark):
    """Two rounds took five audits: what was kept was drawn and measured again."""
    e, looked = Q._first(spark, SF).where("page_id < 6"), []
    true = Q.audit_of
    with mock.patch.object(Q, "audit_of", lambda *given: looked.append(1) or true(*given)):
        out = Q.rounds(e, lambda: F.col("overall_after") > F.col("overall_before"), 2).collect()
    assert len(out) == 6 and len(looked) <= 3


def test_layers_by_tables_as_by_numbers():
    rng = np.random.default_rng(4)
    shapes = [{"type": t, "x1": int(x), "y1": int(y), "x2": int(x + w), "y2": int(y + h), "rgb": int(c), "alpha": int(a)} for t, x, y, w, h, c, a in zip(("ellipse", "rectangle", "image") * 4, rng.integers(-5, 30, 12), rng.integers(-5, 20, 12), rng.integers(1, 20, 12), rng.integers(1, 20, 12), rng.integers(0, 1 << 24, 12), rng.integers(0, 256, 12), strict=True)]
    want = np.full((24, 32, 3), 255, int)
    for s in shapes:
        for y in range(max(0, s["y1"]), min(24, s["y2"])):
            for x in range(max(0, s["x1"]), min(32, s["x2"])):
                a, b = (s["x2"] - s["x1"]) / 2, (s["y2"] - s["y1"]) / 2
                if s["type"] != "ellipse" or ((x - (s["x1"] + s["x2"] - 1) / 2) / a) ** 2 + ((y - (s["y1"] + s["y2"] - 1) / 2) / b) ** 2 <= 1:
                    rgb = np.array([s["rgb"] >> 16, s["rgb"] >> 8 & 255, s["rgb"] & 255])
                    want[y, x] = (rgb * s["alpha"] + want[y, x] * (255 - s["alpha"]) + 127) // 255
    made = T.composited(32, 24, shapes)
    assert made.flags["F_CONTIGUOUS"] is False and made[..., 0].flags["C_CONTIGUOUS"] and (made == want).all() and (from_png(to_png(made)) == want).all()

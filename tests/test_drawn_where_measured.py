"""Pictures are drawn by the task that looks at them: no plan shuffles, joins or broadcasts their pixels."""

import os

import numpy as np
import pytest

from foliograph import plans
from foliograph.operators import edges as E
from foliograph.sources.pictures import drawn, image_of, per_image

SF = "/root/testdata/sf0.001"
QUERIES = "ras06_measured_ghosting ras09_measured_artwork ras10_circles ras10_simple_shapes ras12_cleaned_text ras25_audit_issues ras25_audit_report ras30_objectized ras31_residual_objects ras37_planned_assets sta03_measured_accept fil13_measured_solid itr04_seam_pieces udf05_piece_segments"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", QUERIES.split())
def test_no_pixels_in_the_plan(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "data#" not in plan and "px#" not in plan


def test_images_of_bytes_or_shapes():
    box = {"type": "rectangle", "x1": 2, "y1": 1, "x2": 6, "y2": 4, "rgb": 0x102030}
    image = drawn(8, 5, [box])
    assert (image_of(image.tobytes(), 8, 5) == image).all() and (image_of([box], 8, 5) == image).all() and (image_of([], 8, 5) == 255).all()
    assert image_of(bytes(40), 8, 5).shape == (5, 8)


def test_a_table_may_have_both(spark):
    kind = "array<struct<type:string,x1:int,y1:int,x2:int,y2:int,rgb:int>>"
    df = spark.createDataFrame([(1, 8, 5, None, [("rectangle", 0, 0, 2, 2, 0)]), (2, 8, 5, bytearray(40), None)], f"page_id bigint, width int, height int, data binary, shapes {kind}")
    rows = per_image(df, [("dark", E.pa.int64())], lambda image: {"dark": [int((image == 0).sum())]}).collect()
    assert sorted((r.page_id, r.dark) for r in rows) == [(1, 12), (2, 40)]


def test_circles_of_an_image_as_from_rows_of_its_edges(spark):
    w, h, rng = 480, 270, np.random.default_rng(3)
    rows = []
    for page in range(6):
        shapes = [{"type": "ellipse", "x1": x, "y1": y, "x2": x + 50, "y2": y + 50, "rgb": int(c)} for x, y, c in zip(rng.integers(-10, 440, 6), rng.integers(-10, 230, 6), rng.integers(0, 1 << 24, 6), strict=True)]
        rows.append((page, w, h, drawn(w, h, shapes).tobytes()))
    images = spark.createDataFrame(rows, "page_id bigint, width int, height int, data binary")
    found = E.hough_circles(E.edge_normals(images, 50, 100), w, h, 24, 26, 48)
    want = E.supported(found, E.edge_pixels(images, 50, 150), w, h).collect()
    got = E.strongest(per_image(images, E.CIRCLE, lambda image: E.circles_of(image, 24, 26)), 48, "support").collect()
    key = lambda r: (r.page_id, round(r.x, 9), round(r.y, 9), r.radius, r.votes, round(r.support, 9))
    assert len(want) > 3 and sorted(map(key, got)) == sorted(map(key, want))


def test_channels_as_numpy_says():
    a, b = np.random.default_rng(1).integers(0, 256, (2, 9, 11, 3)).astype(np.uint8)
    assert (E.brightest(a) == a.max(2)).all() and (E.apart(a, b) == np.abs(a.astype(int) - b).max(2)).all()
    high, low = a.max(2).astype(int), a.min(2).astype(int)
    assert (E.saturation(a) == np.where(high > 0, (510 * (high - low) + high) // np.maximum(2 * high, 1), 0)).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_report_measures_once(spark):
    plan = plans.QUERIES["ras25_audit_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1

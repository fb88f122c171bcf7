"""What the library is without its part for training data, and the providers that users may plug in."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest

from foliograph.operators import images
from foliograph.sources import providers

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_llm_part(tmp_path):
    """The entry imports, and keeps its other queries, where that part and the pipeline are gone."""
    at = tmp_path / "copy"
    shutil.copytree(HERE, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.md", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and set(e.oracle_sql()) <= set(q) and not [x for x in q if x.startswith('op') and x[2].isdigit()]"
    done = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(at)})
    assert done.returncode == 0, done.stderr[-800:]


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (5, 9), (4, 7, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert np.array_equal(images.from_png(images.to_png(image)), image)
    with pytest.raises(ValueError):
        images.from_png(b"GIF89a")


def test_orientations():
    """Each number against the corner where a camera puts the scene's first pixel."""
    image = np.array([[1, 2], [3, 4], [5, 6]])
    want = {1: [[1, 2], [3, 4], [5, 6]], 2: [[2, 1], [4, 3], [6, 5]], 3: [[6, 5], [4, 3], [2, 1]], 4: [[5, 6], [3, 4], [1, 2]], 5: [[1, 3, 5], [2, 4, 6]], 6: [[5, 3, 1], [6, 4, 2]], 7: [[6, 4, 2], [5, 3, 1]], 8: [[2, 4, 6], [1, 3, 5]]}
    for k, rows in want.items():
        assert images.upright(image, k).tolist() == rows


def test_providers_are_taken_in_order(spark):
    kind = providers.Registry("vision model")
    kind.add("broken", providers.Missing)
    with pytest.raises(LookupError):
        kind.take(["broken", "unknown"])
    kind.add("fine", providers.TypeVision)
    assert kind.take(["broken", "fine"])[0] == "fine"
    df = spark.createDataFrame([(1, 2, "line", 0.9), (1, 3, "image", 0.7)], "page_id bigint, pos int, type string, confidence double")
    assert sorted(tuple(r) for r in kind.apply(df, ["broken", "fine"]).collect()) == [(1, 2, "a line", 0.5), (1, 3, "a image", 0.7)]
    assert kind.apply(df.where("false"), ["fine"]).count() == 0


def test_engines_over_images(spark):
    """The class is asked, not an object; a painter leaves nothing of a text, regions and segments are those drawn."""
    from foliograph.sources.pictures import drawn

    class Costly(providers.Marching):
        def __init__(self):
            raise AssertionError("made on the driver")

    kind = providers.Registry("painter")
    kind.add("costly", Costly)
    assert kind.take(["costly"])[0] == "costly"
    box = {"type": "rectangle", "x1": 20, "y1": 20, "x2": 120, "y2": 80, "rgb": 0x2050B0}
    text = {"type": "text", "x1": 40, "y1": 30, "x2": 70, "y2": 40, "rgb": 0}
    rows = [(7, 160, 100, drawn(160, 100, [box, text]).tobytes(), [{"x1": 40, "y1": 30, "x2": 70, "y2": 40}])]
    df = spark.createDataFrame(rows, "page_id bigint, width int, height int, data binary, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    (r,) = providers.INPAINTING.apply(df, ["missing", "marching"]).collect()
    assert r.data == drawn(160, 100, [box]).tobytes() and r.painted == 0
    (r,) = providers.LAYOUT.apply(df, ["contours"]).collect()
    assert (r.nth, r.role) == (1, "content_region") and abs(r.x - 20) <= 1 and abs(r.width - 100) <= 2
    assert [(r.x1, r.y1, r.x2, r.y2, r.pixels, r.root) for r in providers.SEGMENTS.apply(df, ["pieces"]).collect()] == [(20, 20, 120, 80, 6000, 0)]
    assert providers.SEGMENTS.apply(df.where("false"), ["pieces"]).count() == 0 and providers.LAYOUT.apply(df.where("false"), ["contours"]).count() == 0

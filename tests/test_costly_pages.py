"""Pages whose measures took most of a task's time: what is shared is made once, with the results that it had."""

import os
from unittest import mock

import numpy as np

from foliograph.operators import audit as A
from foliograph.operators import edges as E
from foliograph.operators import inpaint as I
from foliograph.operators import stats as T
from foliograph.operators import strokes as S
from foliograph.plans import QUERIES
from foliograph.plans import images as Q
from foliograph.sources import store
from foliograph.sources.pictures import drawn, lettered

W, H = 240, 160


def shapes_of(rng, n, w=W, h=H):
    """Shapes that overlap and leave the page, some without a size."""
    x, y, wide, high = rng.integers(-20, w, n), rng.integers(-20, h, n), rng.integers(0, 90, n), rng.integers(0, 50, n)
    kinds = rng.choice(["text", "image", "rectangle", "ellipse", "line"], n)
    return [{"element_id": i, "type": str(k), "role": "title", "x1": int(a), "y1": int(b), "x2": int(a + c), "y2": int(b + d), "rgb": int(q)} for i, (k, a, b, c, d, q) in enumerate(zip(kinds, x, y, wide, high, rng.integers(0, 1 << 24, n), strict=True))]


def test_edges_of_all_parts_at_once():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 256, (2, 40, 60)).astype(np.uint8) // 80 * 80
    boxes = np.array([(x, y, x + w, y + h) for x, y, w, h in zip(rng.integers(0, 40, 30), rng.integers(0, 20, 30), rng.integers(1, 20, 30), rng.integers(1, 20, 30), strict=True)])
    want = [int((E.canny(a[y1:y2, x1:x2], 60, 160) != E.canny(b[y1:y2, x1:x2], 60, 160)).sum()) for x1, y1, x2, y2 in boxes.tolist()]
    assert E.edges_apart(a, b, boxes, 60, 160).tolist() == want and max(want) > 9
    assert E.edges_apart(a, b, boxes[:0], 60, 160).tolist() == []
    assert all((x == E.canny(a, *levels)).all() for x, levels in zip(E.cannies(a, (60, 160), (45, 135)), ((60, 160), (45, 135)), strict=True))


def test_scores_of_a_page_take_three_looks_at_its_edges():
    """Each region had edges of its own, and each of the page's scores those of both images."""
    rng = np.random.default_rng(6)
    shapes = shapes_of(rng, 30)
    source, preview = drawn(W, H, shapes), drawn(W, H, shapes[:20])
    with mock.patch.object(E, "sobel", side_effect=E.sobel) as looks:
        got = T.page_scores(source, preview, shapes)
    assert looks.call_count == 3
    off, regions = np.abs(source.astype(int) - preview), {i: score for what, i, score, _ in got if what == "region"}
    for e in shapes:
        box = slice(max(0, e["y1"]), max(0, e["y2"])), slice(max(0, e["x1"]), max(0, e["x2"]))
        if min(source[box].shape[:2]) < 2:
            assert e["element_id"] not in regions
            continue
        edge = (E.canny(source[box], 60, 160) != E.canny(preview[box], 60, 160)).mean()
        assert regions[e["element_id"]] == max(0.0, 1 - off[box].mean() / 255) * 0.35 + (1 - edge) * 0.65
    assert len(regions) > 20 and len({round(v, 3) for v in regions.values()}) > 5


def test_lines_are_measured_in_few_bits():
    """Distances of ink were floats, and inks whole numbers of 64 bits; long, thick or high ones need more than 16."""
    ink = S.ink_of(lettered("A longer line, in two and more", 3), (30, 30, 60))
    assert S.squares_to_ground(ink).dtype == np.uint16
    for shape, hole in (((4, 900), (0, 0)), ((4, 900), (2, 450)), ((200, 9), (199, 0)), ((170, 600), (0, 599))):
        mask = np.ones(shape, bool)
        mask[hole] = False
        y, x = np.mgrid[: shape[0], : shape[1]]
        assert np.allclose(S.to_ground(mask), np.hypot(y - hole[0], x - hole[1]))
    assert np.isinf(S.to_ground(np.ones((40, 900), bool))).all() and np.isinf(S.middle(S.squares_to_ground(np.ones((5, 7), bool)).ravel()))
    rng = np.random.default_rng(2)
    squares = rng.integers(1, 50, 101).astype(np.uint16)
    assert S.middle(squares) == np.median(np.sqrt(squares.astype(float))) and S.middle(squares[:100]) == np.median(np.sqrt(squares[:100].astype(float)))
    crop = rng.integers(0, 256, (30, 90, 3)).astype(np.uint8)
    for colour in ((30, 30, 60), (200, 170, 90), (255, 255, 255)):
        p = crop.astype(int)
        assert (S.ink_of(crop, colour) == ((np.abs(p - colour).max(2) <= S.INK_OFF) & ((p[..., 0] * 4899 + p[..., 1] * 9617 + p[..., 2] * 1868 + 8192) >> 14 < S.INK_GREY))).all()


def test_holes_of_many_images_are_filled_together():
    """Each pixel of a front was a step of plain Python."""
    rng = np.random.default_rng(8)
    images, masks = [], []
    for h, w in ((160, 240), (90, 70), (160, 240), (20, 30), (20, 30)):
        shapes = shapes_of(rng, 25, w, h)
        images.append(drawn(w, h, shapes))
        masks.append(np.zeros((h, w), bool))
        for s in shapes[:6]:
            masks[-1][max(0, s["y1"]) : max(0, s["y2"]), max(0, s["x1"]) : max(0, s["x2"])] = True
    masks[3][:], masks[4][:] = False, True
    images.append(images[0][..., 1])
    masks.append(masks[0])
    steps = []
    true = I.np.lexsort
    with mock.patch.object(I.np, "lexsort", lambda keys: steps.append(1) or true(keys)):
        whole = I.fast_marching_all(images, masks)
    assert 10 < len(steps) < 400 < sum(int(m.sum()) for m in masks)
    for image, mask, made in zip(images, masks, whole, strict=True):
        assert (made == I.fast_marching(image, mask)).all() and (made[~mask] == image[~mask]).all() and made is not image
    for image, mask, (out, n) in zip(images, masks, I.cleaned_all(images, masks), strict=True):
        alone, m = I.cleaned(image, mask)
        assert (out == alone).all() and n == m <= mask.sum()


def test_a_page_folder_is_written_and_listed_by_tasks(spark, tmp_path):
    """The driver had the names of all pages' folders and files, once as they were written and once as they were read."""
    rows = [(k, f"page {k}") for k in (0, 1, 1023, 1024, 1025, 5000, -7)] + [(None, "none")]
    pages, root = spark.createDataFrame(rows, "page_id bigint, document string"), str(tmp_path / "a b")
    key = lambda r: (r[0] is None, r[0] or 0)
    assert store.write_folders(pages, root) == 8 and sorted(map(tuple, store.read_folders(spark, root).collect()), key=key) == sorted(rows, key=key)
    there = sorted(os.path.relpath(os.path.join(at, f), root) for at, _, files in os.walk(root) for f in files)
    assert len(there) == 8 and "001/page_id=1025/rows.json" in there and not any("/." in f for f in there)
    assert store.write_folders(pages.where("page_id = 1"), root) == 1  # a task that is run again
    assert sorted(map(tuple, store.read_folders(spark, root).collect()), key=key) == sorted(rows, key=key)
    os.mkdir(f"{root}/001/.page_id=9217.left")  # a task that died
    assert store.read_folders(spark, root).count() == 8 and store.read_folders(spark, str(tmp_path / "none")).count() == 0
    made = QUERIES["snk01_store_write"](spark, "/root/testdata/sf0.001")
    assert not made.inputFiles() and made.count() == 25


def test_an_audit_looks_for_components_only_where_something_is():
    """Ten masks of each page were searched, empty ones too."""
    rng = np.random.default_rng(9)
    shapes = [{**s, "residual": True, "changed": False} for s in shapes_of(rng, 20)]
    page, blank = drawn(W, H, shapes), drawn(W, H, [])
    with mock.patch.object(E, "components", side_effect=E.components) as found, mock.patch.object(A, "components", side_effect=A.components) as more:
        same = A.measures(page, page, blank, shapes, page)
        assert found.call_count + more.call_count == 0
        lost = A.measures(page, blank, blank, shapes)
        assert found.call_count > 0
    assert {r[6] for r in same if r[0] in ("missing", "mismatched", "newly_lost", "text_support")} == {0} and next(r[6] for r in lost if r[0] == "missing") > 0
    mask = np.zeros((30, 40), bool)
    assert E.bounds(mask) is None and E.extents(mask) == []
    mask[7:9, 30:] = mask[20, 3] = True
    assert E.bounds(mask) == (3, 7, 40, 21) and E.extents(mask) == [(30, 7, 40, 9, 20), (3, 20, 4, 21, 1)]
    colours = rng.integers(0, 256, (50, 3)).astype(np.uint8)
    assert (A.middle_of(colours) == np.median(colours, axis=0)).all() and (A.middle_of(colours[:49]) == np.median(colours[:49], axis=0)).all()


def test_a_revision_is_measured_by_one_task(spark):
    """A page was drawn and looked at once for each of its two versions."""
    sf = "/root/testdata/sf0.001"
    made = Q.revisions(spark, sf)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    e, before, after = Q.placed(spark, sf, Q.W, Q.H).where("visible"), Q.F.expr(Q.FIRST), Q.F.expr(Q.SECOND)
    apart = Q.compared(e, A.report(Q.audit_of(e, before)), A.report(Q.audit_of(e, after, before)), before, after)
    assert sorted(map(repr, made.select(*apart.columns).collect())) == sorted(map(repr, apart.collect())) and made.count() == 25

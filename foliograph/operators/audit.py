"""What a reconstruction of a page lost, added or changed, measured on three images: the source, the preview of what was rebuilt, and its background.

A task measures a page: masks of pixels, their components, and for each element sums over its box from summed-area
tables. What the measures mean - counters and issues - is decided by rules over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pictures import ellipse, image_of, per_image
from .edges import apart, bounds, brightest, components, dilated, extents, median, saturation
from .pieces import border_colour, closed, stroke

INT = np.int64
# The levels, counts and shares in the measures and rules below are those by which reconstructions are judged.


def summed(mask: np.ndarray) -> np.ndarray:
    """The summed-area table: entry (y, x) is the sum over all rows before y and columns before x."""
    t = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int32)
    np.cumsum(np.cumsum(mask, 0, dtype=np.int32), 1, out=t[1:, 1:])
    return t


def box_sum(table: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> int:
    """Over the box, of any size, by four entries."""
    h, w = table.shape[0] - 1, table.shape[1] - 1
    x1, x2, y1, y2 = (min(max(v, 0), m) for v, m in ((x1, w), (x2, w), (y1, h), (y2, h)))
    return 0 if x1 >= x2 or y1 >= y2 else int(table[y2, x2] - table[y1, x2] - table[y2, x1] + table[y1, x1])


def windowed(mask: np.ndarray, reach: int) -> np.ndarray:
    """How many pixels of a mask lie in the square window around each pixel."""
    t, (h, w) = summed(mask), mask.shape
    low = lambda n: np.maximum(np.arange(n) - reach, 0)
    high = lambda n: np.minimum(np.arange(n) + reach + 1, n)
    a, b, c, d = low(h)[:, None], high(h)[:, None], low(w)[None], high(w)[None]
    return t[b, d] - t[a, d] - t[b, c] + t[a, c]


def opened(mask: np.ndarray, reach: int) -> np.ndarray:
    """What a square of 2 * reach + 1 pixels covers when it moves inside the mask; beyond the image all counts as inside."""
    return dilated(~dilated(~mask, reach), reach)


def bounded(mask: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    """Components of a mask whose small gaps are closed: `least` pixels and more, no specks, no boxes over 62 % of the page."""
    h, w = mask.shape

    def fits(c: tuple) -> bool:
        cw, ch = c[2] - c[0], c[3] - c[1]
        return c[4] >= least and (min(cw, ch) >= 3 or stroke(cw, ch, c[4], w, h)) and cw * ch <= w * h * 0.62

    box = bounds(mask)
    if box is None:
        return []
    x, y = max(0, box[0] - 2), max(0, box[1] - 2)  # what is closed lies in the mask's own bounds
    found = [(a + x, b + y, c + x, d + y, n) for a, b, c, d, n in extents(closed(mask[y : box[3] + 2, x : box[2] + 2]))]
    return [c for c in found if fits(c)]


def darkest(image: np.ndarray) -> np.ndarray:
    """The smallest channel of each pixel."""
    return np.minimum(np.minimum(image[..., 0], image[..., 1]), image[..., 2])


def share_of(mask: np.ndarray) -> float:
    return np.count_nonzero(mask) / mask.size


def leading(image: np.ndarray) -> np.ndarray:
    """Which channel of each pixel is the largest, the first of equals."""
    r, g, b = (image[..., k] for k in range(3))
    return np.where(b > np.maximum(r, g), 2, (g > r).astype(np.int8))


def middle_of(colours: np.ndarray) -> np.ndarray:
    """The median of each channel."""
    return np.array([median(colours[:, k]) for k in range(3)])


def flat_surface(image: np.ndarray) -> np.ndarray | None:
    """The colour of a page that is flat but not white, if it is."""
    rim = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
    colour = middle_of(rim).astype(np.uint8)
    off = lambda p: apart(p, colour) <= 10
    return colour if 255 - int(colour.min()) >= 12 and off(rim).mean() >= 0.9 and share_of(off(image)) >= 0.85 else None


def text_support(value: np.ndarray, strength: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Of a gap in a text's box what is a plate rather than the pale rim of letters."""
    if not gap.any() or min(gap.shape) < 10:
        return np.zeros_like(gap)
    ink = (value < 225) | (strength > 32)
    coherent = np.zeros(gap.size, bool)
    for x1, y1, x2, y2, n, places in components(opened(gap & ~dilated(ink, 2), 2)):
        if x2 - x1 >= 10 and y2 - y1 >= 10 and n >= 80:
            coherent[places] = True
    return dilated(coherent.reshape(gap.shape), 2) & gap


def shown(e: dict, height: int, width: int) -> np.ndarray:
    """The pixels of an element inside its box."""
    x1, y1, x2, y2 = max(0, e["x1"]), max(0, e["y1"]), min(width, e["x2"]), min(height, e["y2"])
    if e["type"] != "ellipse":
        return np.ones((y2 - y1, x2 - x1), bool)
    return ellipse(e["x1"], e["y1"], e["x2"], e["y2"], width, height)


MEASURE = [("what", pa.string()), ("element", pa.int64()), *((c, pa.int32()) for c in ("x1", "y1", "x2", "y2")), ("pixels", pa.int64()), ("share", pa.float64())]


#: Measures that only a page with an earlier preview has.
OF_EDITS = ("newly_lost", "largest_new_loss", "outside_change")


def slices_in(h: int, w: int, b: tuple[int, int, int, int], pad: int = 0) -> tuple[slice, slice]:
    """A box of an image of h rows of w, wider by pad on each side as far as the image goes."""
    return slice(max(0, b[1] - pad), min(h, b[3] + pad)), slice(max(0, b[0] - pad), min(w, b[2] + pad))


class Looked:
    """What an audit asks of a source and its elements, whatever was made of them: saturation and value, distance from the rim, boxes, and masks of what owns pixels, stands out or has detail."""

    def __init__(self, source: np.ndarray, elements: Sequence[dict]) -> None:
        h, w = source.shape[:2]
        self.sat, self.val = saturation(source), brightest(source)
        self.rim = middle_of(np.concatenate([source[0], source[-1], source[:, 0], source[:, -1]])).astype(INT)
        self.from_rim = apart(source, self.rim)
        boxes = [(e, (max(0, e["x1"]), max(0, e["y1"]), min(w, e["x2"]), min(h, e["y2"]))) for e in elements]
        self.boxes = [(e, b) for e, b in boxes if b[0] < b[2] and b[1] < b[3]]
        self.texts, self.images = ([x for x in self.boxes if x[0]["type"] == t] for t in ("text", "image"))
        self.owner, self.residual, self.local, self.in_text = (np.zeros((h, w), bool) for _ in range(4))
        for e, b in self.boxes:
            if e["type"] == "ellipse":
                self.owner[slices_in(h, w, b)] |= shown(e, h, w)
            elif e["type"] != "text":
                self.owner[slices_in(h, w, b)] = True
                if e["residual"] and e["type"] == "image":
                    self.residual[slices_in(h, w, b)] = True
        for _, b in self.images:
            if (b[2] - b[0]) * (b[3] - b[1]) <= h * w * 0.55:
                self.local[slices_in(h, w, b)] = True
        for _, b in self.texts:
            self.in_text[slices_in(h, w, b, 2)] = True
        self.surface = flat_surface(source)
        self.salient = apart(source, border_colour(source)) >= 5
        self.coloured = (self.sat >= 55) & (self.val >= 35)
        self.detail = (self.from_rim >= 8) & (darkest(source) < 253)


def measures(source: np.ndarray, preview: np.ndarray, background: np.ndarray, elements: Sequence[dict], earlier: np.ndarray | None = None, looked: Looked | None = None) -> list[tuple]:
    """(what, element, x1, y1, x2, y2, pixels, share) of a page; elements are those that are active.

    earlier: the preview before an edit, if what the edit lost and changed is asked for; elements then say which were changed.
    looked: of source and elements, if it is there already.
    """
    h, w = source.shape[:2]
    area = h * w
    out: list[tuple] = []
    s = Looked(source, elements) if looked is None else looked
    sat, val, rim, from_rim, boxes, texts, images, owner, residual, local, in_text, surface, salient = s.sat, s.val, s.rim, s.from_rim, s.boxes, s.texts, s.images, s.owner, s.residual, s.local, s.in_text, s.surface, s.salient

    def page(what: str, pixels: int, share: float | None = None) -> None:
        out.append((what, None, 0, 0, w, h, int(pixels), share))

    def part(what: str, c: tuple, element: int | None = None, share: float | None = None) -> None:
        out.append((what, element, *c[:4], int(c[4]), share))

    src, pre = source, preview
    psat, pval = saturation(preview), brightest(pre)
    error = apart(src, pre)
    white = darkest(preview) >= 253

    def slices(b: tuple[int, int, int, int], pad: int = 0) -> tuple[slice, slice]:
        return slices_in(h, w, b, pad)

    # the page's own surface and its background
    if surface is not None:
        lost = (apart(src, surface) <= 10) & (apart(pre, surface) >= 20) & ~in_text
        page("surface_mismatch", np.count_nonzero(lost))
        page("surface_baked", 0, share_of(darkest(background) >= 250))
    page("white_preview", 0, share_of(white))
    page("white_background", 0, share_of(darkest(background) >= 250))
    ground = darkest(background) <= 249
    if surface is not None:
        ground &= apart(background, surface) > 3
    for c in extents(ground):
        cw, ch = c[2] - c[0], c[3] - c[1]
        if c[4] >= max(24, round(area * 0.0001)) and (min(cw, ch) >= 3 or stroke(cw, ch, c[4], w, h)):
            part("background_residual", c)

    # pale support that has become white
    pale = (val >= 225) & (sat <= 32) & white & (error >= 3)
    page("pale_asset_gap", np.count_nonzero(pale & local))
    if rim.mean() < 253 and share_of(from_rim <= 1) >= 0.65:
        pale &= from_rim > 1
    bound, unowned = np.zeros((h, w), bool), np.zeros((h, w), bool)
    some_pale = bool(pale.any())
    for e, b in texts:
        at, n = slices(b, 2), 0
        if some_pale and pale[at].any():
            support = text_support(val[at], sat[at], pale[at] & (darkest(src[at]) <= 250))
            bound[at] |= support
            n = np.count_nonzero(support)
            pale[at] = False
        part("text_support", (*b, n), e["element_id"])
    page("text_bound_pale_gap", np.count_nonzero(bound))
    for e, b in images:
        size = (b[2] - b[0]) * (b[3] - b[1])
        if some_pale and size <= area * 0.55:
            gap = pale[slices(b)] & ~shown(e, h, w)
            pairs = gap[1:, 1:] & gap[:-1, 1:] & gap[1:, :-1] & gap[:-1, :-1]  # squares of two
            stable = np.zeros_like(gap)
            for dy in (slice(1, None), slice(None, -1)):
                for dx in (slice(1, None), slice(None, -1)):
                    stable[dy, dx] |= pairs
            if np.count_nonzero(stable) >= max(16, round(size * 0.01)):
                unowned[slices(b)] |= stable
                part("pale_gap", (*b, np.count_nonzero(stable)), e["element_id"])
    page("unowned_pale_support", np.count_nonzero(unowned))

    # what stands out in the source and is gone, or wrong, in the preview
    erased = white & (error >= 2)
    gone = s.coloured & erased & in_text
    for e, b in texts:
        at = slices(b, 2)
        if gone[at].any():  # a glyph is none of what is gone
            gone[at] &= apart(src[at], np.array([e["rgb"] >> 16, e["rgb"] >> 8 & 255, e["rgb"] & 255])) > 90
    lost, salient = salient & erased & ~in_text, salient & ~in_text
    box = bounds(gone)
    if box is not None:
        near_by, at = slices(box, 6), slices(box)
        inner = slice(box[1] - near_by[0].start, box[3] - near_by[0].start), slice(box[0] - near_by[1].start, box[2] - near_by[1].start)
        rendered = (psat[near_by] >= 40) & (pval[near_by] >= 35)
        first, second = leading(src[at]), leading(pre[near_by])
        for channel in range(3):
            gone[at] &= ~((first == channel) & dilated(rendered & (second == channel), 6)[inner])
        kept = np.zeros(area, bool)
        for c in components(gone):
            cw, ch = c[2] - c[0], c[3] - c[1]
            if c[4] >= 400 or (c[4] >= max(150, round(area * 0.00008)) and min(cw, ch) >= 12 and c[4] / (cw * ch) >= 0.6):
                kept[c[5]] = True
        lost |= kept.reshape(h, w)
        salient |= kept.reshape(h, w)
    missing, mismatched = salient & erased, salient & (error >= 48) & ~white
    page("salient", np.count_nonzero(salient))
    page("missing", np.count_nonzero(missing))
    page("covered_missing", np.count_nonzero(missing & owner))
    page("mismatched", np.count_nonzero(mismatched))
    page("largest_missing", max((c[4] for c in extents(missing)), default=0))
    if earlier is not None:
        was = earlier
        fresh = missing & ~((darkest(earlier) >= 253) & (apart(src, was) >= 2))
        page("newly_lost", np.count_nonzero(fresh))
        page("largest_new_loss", max((c[4] for c in extents(fresh)), default=0))
        meant = np.zeros((h, w), bool)
        for e, b in boxes:
            meant[slices(b, 2)] |= e["changed"]
        page("outside_change", 0, np.count_nonzero((apart(pre, was) > 8) & ~meant) / max(1, area - np.count_nonzero(meant)))
    for what, mask in (("large_loss", missing), ("large_mismatch", mismatched)):
        for c in extents(mask) if np.count_nonzero(mask) >= area * 0.62 else ():
            if c[4] >= area * 0.62:
                part(what, c)
    for c in bounded(mismatched, max(24, round(area * 0.0001))):
        part("mismatch", c)
    bleak = residual & (val >= 225)
    added = bleak & (val >= 240) & (sat <= 30) & (pval <= 150) if bleak.any() else bleak
    faded = bleak & (sat >= 12) & (sat <= 55) & (pval >= 248) & (psat <= 10) & (error >= 15) if bleak.any() else bleak
    washed = (sat >= 60) & (val >= 35) & (psat <= 30) & (pval >= 230) & residual
    for what, mask, least, wide, low, dense, ratio in (("false_addition", added, max(300, round(area * 0.00018)), max(36, round(w * 0.025)), 5, 0.35, 2.5), ("faded_plate", faded, max(120, round(area * 0.00008)), 20, 5, 0.35, 0), ("washed", washed, max(2000, round(area * 0.001)), max(80, round(w * 0.05)), 10, 0.4, 0)):
        for c in bounded(mask, least):
            cw, ch = c[2] - c[0], c[3] - c[1]
            if cw >= wide and ch >= low and cw / ch >= ratio and c[4] / (cw * ch) >= dense:
                part(what, c)
    for c in bounded(lost, 9):
        if c[4] < max(40, round(area * 0.00003)):
            continue
        values = src[slices(c)][lost[slices(c)]]
        middle = middle_of(values)
        plate = (np.abs(values - middle).max(1) <= 9).mean() >= 0.65 and np.abs(middle - rim).max() <= 35 and len(values) / ((c[2] - c[0]) * (c[3] - c[1])) >= 0.7
        part("lost_plate" if plate else "lost_object", c)

    # owners
    detail, blank = s.detail, s.detail & white
    for e, b in images:
        size = (b[2] - b[0]) * (b[3] - b[1])
        if size >= area * 0.9:
            part("monolithic", (*b, size), e["element_id"], 1.0)
        n = np.count_nonzero(detail[slices(b)])
        if n >= max(24, round(area * 0.0001), size * 0.05):
            part("owner_detail", (*b, n), e["element_id"], np.count_nonzero(blank[slices(b)]) / n)
    return out


def measured(images: DataFrame) -> DataFrame:
    """page_id and MEASURE: a row for each measure of each page.

    images: the source, with columns preview, background and perhaps earlier (data or shapes of images of its size) and elements,
    array<struct<element_id, type, x1, y1, x2, y2, rgb, residual, changed>>.
    """

    def of(source: np.ndarray, preview: bytes, background: bytes, elements: list[dict] | None, earlier: bytes | None = None) -> dict:
        image = lambda given: image_of(given, source.shape[1], source.shape[0])
        rows = measures(source, image(preview), image(background), elements or [], None if earlier is None else image(earlier))
        return {name: [r[k] for r in rows] for k, (name, _) in enumerate(MEASURE)}

    return per_image(images, MEASURE, of)


def measured_twice(images: DataFrame) -> DataFrame:
    """measured() of the earlier preview, where after is false, and then of the preview after it, by one task that draws and looks at the source once."""

    def of(source: np.ndarray, preview: bytes, background: bytes, earlier: bytes, elements: list[dict] | None) -> dict:
        now, ground, was = (image_of(given, source.shape[1], source.shape[0]) for given in (preview, background, earlier))
        looked = Looked(source, elements or [])
        rows = [(False, *r) for r in measures(source, was, ground, elements or [], None, looked)] + [(True, *r) for r in measures(source, now, ground, elements or [], was, looked)]
        return {name: [r[k] for r in rows] for k, name in enumerate(("after", *(n for n, _ in MEASURE)))}

    return per_image(images, [("after", pa.bool_()), *MEASURE], of)


def problem_of() -> Column:
    """What a measure says is wrong, if anything."""
    return (
        F.when((F.col("what") == "surface_baked") & (F.col("share") < 0.995), "pageSurfaceBakedIntoBackground")
        .when((F.col("what") == "surface_mismatch") & (F.col("pixels") > F.greatest(F.lit(100), F.round(F.col("x2") * F.col("y2") * 0.02))), "pageSurfaceLost")
        .when((F.col("what") == "text_support") & (F.col("pixels") >= 80), "paleAssetGap").when(F.col("what") == "pale_gap", "paleAssetGap")
        .when(F.col("what") == "large_loss", "largeVisualLoss").when(F.col("what").isin("large_mismatch", "mismatch", "false_addition", "faded_plate", "washed"), "visualContentMismatch")
        .when(F.col("what") == "lost_plate", "missingBackplate").when(F.col("what") == "lost_object", "missingVisualObject").when(F.col("what") == "monolithic", "monolithicPageImage")
        .when((F.col("what") == "owner_detail") & (F.col("share") >= 0.8), "blankVisualOwner").when(F.col("what") == "background_residual", "assetBakedIntoBackground")
    )


def issues(rows: DataFrame) -> DataFrame:
    """(page_id, problem, element, x1, y1, x2, y2, pixels) of what is wrong."""
    return rows.withColumn("problem", problem_of()).where("problem IS NOT NULL").select("page_id", "problem", "element", "x1", "y1", "x2", "y2", "pixels")


def report(rows: DataFrame, *by: str) -> DataFrame:
    """A row of counters for each page, and for each value of further columns, all from one look at its measures: those of a page cost far more than its counters."""

    def total(*whats: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("what").isin(*whats), F.col("pixels"))), F.lit(0)).cast("long")

    def n(*whats: str, more: Column | None = None) -> Column:
        hit = F.col("what").isin(*whats)
        return F.count_if(hit if more is None else hit & more)

    wrong = ("false_addition", "faded_plate", "washed")
    shares = (*(F.max(F.when(F.col("what") == w, F.col("share"))).alias(w) for w in ("white_background", "white_preview", "outside_change")), *(F.max(F.when(F.col("what") == w, F.col("pixels"))).alias(w) for w in ("newly_lost", "largest_new_loss")))
    made = rows.groupBy("page_id", *by).agg(
        n("lost_plate").alias("missing_backplates"), n("lost_object", "large_loss").alias("missing_objects"), n("owner_detail", more=F.col("share") >= 0.8).alias("blank_owners"),
        n("mismatch", "large_mismatch", *wrong).alias("mismatch_regions"), total("mismatched", *wrong).alias("mismatch"), total("salient").alias("salient"), total("false_addition").alias("false_addition"), total("faded_plate").alias("faded"), total("washed").alias("washed"), total("missing").alias("missing"),
        total("covered_missing").alias("covered_missing"), total("largest_missing").alias("largest"), total("pale_asset_gap").alias("pale"), total("unowned_pale_support").alias("unowned_pale"), total("text_bound_pale_gap").alias("support"), total("surface_mismatch").alias("surface"),
        n("monolithic").alias("monolithic"), n("background_residual").alias("residual_regions"), total("background_residual").alias("residual"),
        *shares, F.count_if(problem_of().isNotNull()).alias("issues"),
    )
    coverage = F.round(1 - F.col("missing") / F.greatest(F.lit(1), F.col("salient")), 4)
    return made.withColumn("coverage", coverage)

"""What the pixels of elements are like: measured once for each page, for rules that ask for it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.pictures import GROUND, grey, image_of, per_image
from .audit import box_sum, summed
from .edges import apart, cannies, canny, edges_apart, saturation
from .pieces import border_colour

STATS = [("element_id", pa.int64()), ("pixels", pa.int64()), *((n, pa.float64()) for n in ("fill", "saturation", "delta", "alike", "spread")), ("edges", pa.int64()), ("differs", pa.int64())]


def stats_of(image: np.ndarray, elements: Sequence[dict]) -> dict[str, list]:
    """For each element: pixels off the ground's colour and their share of its box; of those the median's saturation and distance from the ground, the
    share within 12 of the median and the largest deviation of a channel; edges outside texts, and pixels off the ground by 8 outside texts.

    Counts over boxes are looked up in summed-area tables; all else follows from how often each element has each level of a channel.
    """
    h, w = image.shape[:2]
    ground = border_colour(image)
    off = apart(image, ground)
    texts, boxes = np.zeros((h, w), bool), []
    for e in elements:
        x1, y1, x2, y2 = box = max(0, e["x1"]), max(0, e["y1"]), min(w, e["x2"]), min(h, e["y2"])
        boxes.append(box)
        if e["type"] == "text":
            texts[y1 : max(y1, y2), x1 : max(x1, x2)] = True
    edges, far = summed(canny(image, 50, 130) & ~texts), summed((off >= 8) & ~texts)
    colour, on = image[..., 0].astype(np.int32) << 16 | image[..., 1].astype(np.int32) << 8 | image[..., 2], off >= 5
    parts = [colour[y1 : max(y1, y2), x1 : max(x1, x2)][on[y1 : max(y1, y2), x1 : max(x1, x2)]] for x1, y1, x2, y2 in boxes]
    n = np.array([len(p) for p in parts], np.int64)
    whose, values = np.repeat(np.arange(len(n)), n), np.concatenate([*parts, np.zeros(0, np.int32)])
    middle, spread = np.empty((len(n), 3)), np.zeros(len(n))
    alike = np.ones(len(values), bool)
    for k, level in enumerate((values >> 16, values >> 8 & 255, values & 255)):
        counts = np.bincount(whose * 256 + level, minlength=256 * len(n)).reshape(-1, 256)
        upto = counts.cumsum(1)
        low, high = ((upto <= m[:, None]).sum(1) for m in ((n - 1) // 2, n // 2))
        middle[:, k] = np.where(n > 0, (low + high) / 2, ground[k])
        total, squares = counts @ np.arange(256), counts @ np.arange(256) ** 2
        spread = np.maximum(spread, np.sqrt(n * squares - total**2) / np.maximum(n, 1))
        alike &= np.abs(level - middle[whose, k]) <= 12
    strength = np.where(n > 0, saturation(middle.astype(np.uint8)[None])[0], 0).astype(float)
    near = np.bincount(whose[alike], minlength=len(n)) / np.maximum(n, 1)
    x1, y1, x2, y2 = np.array(boxes, np.int64).reshape(-1, 4).T
    made = [e["element_id"] for e in elements], n, n / np.maximum(1, (x2 - x1) * (y2 - y1)), strength, np.abs(middle - ground).max(1, initial=0.0), near, spread, [box_sum(edges, *b) for b in boxes], [box_sum(far, *b) for b in boxes]
    return {name: v if isinstance(v, list) else v.tolist() for (name, _), v in zip(STATS, made, strict=True)}


def element_stats(images: DataFrame, *kept: tuple[str, pa.DataType]) -> DataFrame:
    """page_id, STATS and kept, further fields of the elements; images have elements, array<struct<element_id, type, x1, y1, x2, y2>>."""

    def of(image: np.ndarray, elements: list[dict] | None) -> dict:
        return stats_of(image, elements or []) | {n: [e[n] for e in elements or []] for n, _ in kept}

    return per_image(images, [*STATS, *kept], of)


#: The levels of edges that count as ghosts, and of those that two images are compared by.
GHOSTS, COMPARED = (45, 135), (60, 160)


def ghosts(source: np.ndarray, preview: np.ndarray, texts: np.ndarray) -> float:
    """How much denser a preview's edges are in the texts' boxes than the source's, 1.8 times, 0.3 at most."""
    n = np.count_nonzero(texts)
    return min(0.3, 1.8 * max(0.0, np.count_nonzero(preview & texts) / n - np.count_nonzero(source & texts) / n)) if n else 0.0


def ghosting(source: np.ndarray, preview: np.ndarray, texts: np.ndarray) -> float:
    """ghosts() of two images."""
    return ghosts(canny(source, *GHOSTS), canny(preview, *GHOSTS), texts) if texts.any() else 0.0


def composited(width: int, height: int, layers: Sequence[dict]) -> np.ndarray:
    """Boxes and ellipses with an alpha, from the lowest layer up, over a white page: each over what is below it, rounded after each."""
    planes, levels = np.full((3, height, width), GROUND, np.uint8), np.arange(256)
    for s in layers:
        x1, y1, x2, y2 = max(0, s["x1"]), max(0, s["y1"]), min(width, s["x2"]), min(height, s["y2"])
        if x1 >= x2 or y1 >= y2:
            continue
        alpha, inside = s["alpha"], None
        if s["type"] == "ellipse":
            yy, xx = np.ogrid[y1:y2, x1:x2]
            a, b = max(0.5, (s["x2"] - s["x1"]) / 2), max(0.5, (s["y2"] - s["y1"]) / 2)
            inside = ((xx - (s["x1"] + s["x2"] - 1) / 2) / a) ** 2 + ((yy - (s["y1"] + s["y2"] - 1) / 2) / b) ** 2 <= 1
        for plane, level in zip(planes, (s["rgb"] >> 16, s["rgb"] >> 8 & 255, s["rgb"] & 255), strict=True):
            over = ((level * alpha + levels * (255 - alpha) + 127) // 255).astype(np.uint8)  # what each level below becomes
            box = plane[y1:y2, x1:x2]
            np.copyto(box, over.take(box), where=True if inside is None else inside)
    return planes.transpose(1, 2, 0)


#: What a masked share of pixels and edges counts for in the scores of a page: (pixels, edges).
SHARES = {"text": (0.35, 0.65), "layout": (0.25, 0.75), "component": (0.45, 0.55), "background": (0.7, 0.3)}
#: How much an element's region counts for.
WEIGHTS = {"main_title": 3.0, "text": 2.0, "image": 1.5}
SCORE = [("what", pa.string()), ("element_id", pa.int64()), ("score", pa.float64()), ("weight", pa.float64())]


def page_scores(source: np.ndarray, preview: np.ndarray, elements: Sequence[dict]) -> list[tuple]:
    """(what, element, score, weight): text, layout, component and background of the page, its colour and ghosting, and a region for each element.

    Two images are as alike as their colours and their edges are, from 0 to 1, and 1 where there is nothing to compare. The edges of a region are
    those of its crop, as an image of its own; crops that are the same pixel for pixel need none.
    """
    h, w = source.shape[:2]
    planes = [[image[..., k] for k in range(image.shape[2])] if image.ndim == 3 else [image] for image in (source, preview)]
    off = np.zeros((h, w), np.int16)
    for a, b in zip(*planes, strict=True):
        off += np.maximum(a, b) - np.minimum(a, b)
    deep = len(planes[0])
    masks = {n: np.zeros((h, w), bool) for n in ("text", "component")}
    boxes = np.array([[min(max(0, e[c]), w if c[0] == "x" else h) for c in ("x1", "y1", "x2", "y2")] for e in elements], np.int64).reshape(-1, 4)
    changed = np.zeros(len(boxes), np.int64)
    for k, (e, (x1, y1, x2, y2)) in enumerate(zip(elements, boxes.tolist(), strict=True)):
        masks["text" if e["type"] == "text" else "component"][y1:y2, x1:x2] = True
        changed[k] = off[y1 : max(y1, y2), x1 : max(x1, x2)].sum(dtype=np.int64)
    size = boxes[:, 2:] - boxes[:, :2]
    some, edges = (size.min(1, initial=w + h) >= 2) & (changed > 0), np.zeros(len(boxes), np.int64)
    luma = grey(source), grey(preview)
    edges[some] = edges_apart(*luma, boxes[some], *COMPARED)
    out: list[tuple] = []
    for e, (wide, high), total, other in zip(elements, size.tolist(), changed.tolist(), edges.tolist(), strict=True):
        if min(wide, high) >= 2:
            out.append(("region", e["element_id"], max(0.0, 1 - total / (wide * high * deep) / 255) * 0.35 + (1 - other / (wide * high)) * 0.65, WEIGHTS.get(e["role"]) or WEIGHTS.get(e["type"], 1.0)))
    masks["layout"] = masks["text"] | masks["component"]
    masks["background"] = ~masks["layout"]
    (first, was), (second, now) = (cannies(image, COMPARED, GHOSTS) for image in luma)
    apart_ = first != second
    for what, (p, q) in SHARES.items():
        n = np.count_nonzero(masks[what])
        pixel, edge = (max(0.0, 1 - int(off[masks[what]].sum(dtype=np.int64)) / (n * deep) / 255), 1 - np.count_nonzero(apart_ & masks[what]) / n) if n else (1.0, 1.0)
        out.append((what, None, pixel * p + edge * q, None))
    within = masks["layout"] if masks["layout"].any() else np.ones((h, w), bool)
    n = np.count_nonzero(within)
    mean = [np.array([int(plane[within].sum(dtype=np.int64)) / n for plane in image]) for image in planes]
    far = float(np.linalg.norm(mean[0] - mean[1]))
    return [*out, ("colour", None, max(0.0, 1 - far / (255 * np.sqrt(3))), None), ("ghosting", None, ghosts(was, now, masks["text"]), None)]


def image_scores(images: DataFrame) -> DataFrame:
    """page_id and SCORE; images have preview (data or shapes of an image of its size) and elements, array<struct<element_id, type, role, x1, y1, x2, y2>>."""

    def of(source: np.ndarray, preview: bytes, elements: list[dict] | None) -> dict:
        rows = page_scores(source, image_of(preview, source.shape[1], source.shape[0]), elements or [])
        return {n: [r[k] for r in rows] for k, (n, _) in enumerate(SCORE)}

    return per_image(images, SCORE, of)

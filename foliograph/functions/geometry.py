"""The algebra of boxes, as column expressions. A box is four columns: left, top, right, bottom."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def w(self) -> Column:
        return self.x2 - self.x1

    @property
    def h(self) -> Column:
        return self.y2 - self.y1


def box(prefix: str = "") -> Box:
    """The box in columns named prefix + x1, y1, x2, y2."""
    return Box(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))


def from_size(x: Column, y: Column, w: Column, h: Column) -> Box:
    """A box of a corner and a size; missing values count as 0."""
    x, y, w, h = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (x, y, w, h))
    return Box(x, y, x + w, y + h)


def clip(b: Box, width: float, height: float) -> Box:
    """Edges rounded half to even and held to the canvas."""

    def held(c: Column, most: float) -> Column:
        return F.least(F.greatest(F.bround(c, 0), F.lit(0.0)), F.lit(float(most)))

    return Box(held(b.x1, width), held(b.y1, height), held(b.x2, width), held(b.y2, height))


def is_empty(b: Box) -> Column:
    return (b.x2 <= b.x1) | (b.y2 <= b.y1)


def area(b: Box) -> Column:
    return F.greatest(b.w, F.lit(0.0)) * F.greatest(b.h, F.lit(0.0))


def intersects(a: Box, b: Box) -> Column:
    """Whether the insides meet; touching edges don't."""
    return (F.least(a.x2, b.x2) > F.greatest(a.x1, b.x1)) & (F.least(a.y2, b.y2) > F.greatest(a.y1, b.y1))


def intersection(a: Box, b: Box) -> Column:
    """Area of the common part."""
    return F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0)) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))


def coverage(a: Box, b: Box, least_area: float = 1.0) -> Column:
    """The share of a that b covers; a's area counts as least_area at least."""
    return intersection(a, b) / F.greatest(area(a), F.lit(least_area))


def overlap_min(a: Box, b: Box) -> Column:
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1.0))


def iou(a: Box, b: Box) -> Column:
    common = intersection(a, b)
    return common / F.greatest(area(a) + area(b) - common, F.lit(1.0))


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def center(b: Box) -> tuple[Column, Column]:
    return b.x1 + b.w / 2, b.y1 + b.h / 2


def center_inside(a: Box, b: Box) -> Column:
    """Whether a's centre lies in b, edges included."""
    cx, cy = center(a)
    return cx.between(b.x1, b.x2) & cy.between(b.y1, b.y2)


def center_in_ellipse(a: Box, b: Box, most: float = 0.82) -> Column:
    """Whether a's centre lies well inside the ellipse that b bounds."""
    (ax, ay), (bx, by) = center(a), center(b)
    u, v = (ax - bx) / F.greatest(b.w / 2, F.lit(1.0)), (ay - by) / F.greatest(b.h / 2, F.lit(1.0))
    return u * u + v * v <= most


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def near(a: Box, b: Box, factor: float = 1.6) -> Column:
    """Whether centres are as close as the smallest side allows, with some of the larger width on top."""
    side = F.greatest(F.least(a.w, a.h, b.w, b.h), F.lit(8.0))
    return center_distance(a, b) <= side * factor + F.greatest(a.w, b.w) * 0.75


def gap(a: Box, b: Box) -> Column:
    """Distance between two boxes along the axis where they are farther apart, 0 if they meet."""
    dx = F.greatest(a.x1 - b.x2, b.x1 - a.x2, F.lit(0.0))
    dy = F.greatest(a.y1 - b.y2, b.y1 - a.y2, F.lit(0.0))
    return F.greatest(dx, dy)


def normalised_to_pixels(left: Column, top: Column, w: Column, h: Column, width: int, height: int, max_area: float = 0.8, min_side: int = 24) -> Box:
    """Pixels of a box in shares of the canvas; null where the shares or the size aren't allowed."""
    good = (left >= 0) & (left < 1) & (top >= 0) & (top < 1) & (w > 0) & (h > 0) & (left + w <= 1.01) & (top + h <= 1.01) & (w * h <= max_area)
    b = clip(Box(left * width, top * height, (left + w) * width, (top + h) * height), width, height)
    good &= (b.w >= min_side) & (b.h >= min_side)
    return Box(*(F.when(good, c) for c in b))


def bounded_move(now: Column, target: Column, most: Column, low: Column, high: Column) -> Column:
    """target, but not farther from now than most, and within low and high."""
    return F.least(F.greatest(F.greatest(now - most, F.least(now + most, target)), low), high)


def in_canvas(b: Box, width: float, height: float) -> Column:
    """The share of a box that lies on the canvas."""
    canvas = Box(F.lit(0.0), F.lit(0.0), F.lit(float(width)), F.lit(float(height)))
    return intersection(b, canvas) / F.greatest(area(b), F.lit(1.0))


def displacement(a: Box, b: Box) -> Column:
    """How far a corner moved, in line heights of b."""
    return F.greatest(F.abs(a.x1 - b.x1), F.abs(a.y1 - b.y1)) / F.greatest(b.h, F.lit(8.0))


def aspect_distortion(a: Box, b: Box) -> Column:
    return F.abs(F.ln((a.w / a.h) / (b.w / b.h)))


def sane(c: Column, low: float, high: Column | float) -> Column:
    """A finite number in the range; what isn't one counts as 0."""
    c = F.coalesce(c.cast("double"), F.lit(0.0))
    c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)
    return F.least(F.greatest(c, F.lit(float(low))), high if isinstance(high, Column) else F.lit(float(high)))


def is_page_environment(b: Box, width: float, height: float) -> Column:
    """Whether a box is the page's surface rather than an object on it."""
    share = area(b) / (width * height)
    edges = sum(((c).cast("int") for c in (b.x1 <= 0.03 * width, b.y1 <= 0.03 * height, b.x2 >= 0.97 * width, b.y2 >= 0.97 * height)), F.lit(0))
    return (share >= 0.75) | ((b.w >= 0.88 * width) & (b.h >= 0.70 * height)) | ((edges >= 3) & (share >= 0.45))


def is_stroke(b: Box, pixels: Column, width: float, height: float) -> Column:
    """Whether so many pixels in a box are a line worth keeping."""
    short, long = F.least(b.w, b.h), F.greatest(b.w, b.h)
    return (short <= 3) & (long >= max(24.0, 0.06 * max(width, height))) & (long / F.greatest(short, F.lit(1.0)) >= 8) & (pixels >= F.greatest(F.lit(12.0), 0.55 * long))


def circularity(area_: Column, perimeter: Column) -> Column:
    return 4 * F.pi() * area_ / F.greatest(perimeter * perimeter, F.lit(1.0))


def to_asset(b: Box, frame: Box, width: Column, height: Column) -> Box:
    """b in pixels of an asset that fills frame."""

    def along(c: Column, start: Column, size: Column, most: Column) -> Column:
        return F.least(F.greatest(F.bround((c - start) * most / F.greatest(size, F.lit(1.0)), 0), F.lit(0.0)), most)

    return Box(along(b.x1, frame.x1, frame.w, width), along(b.y1, frame.y1, frame.h, height), along(b.x2, frame.x1, frame.w, width), along(b.y2, frame.y1, frame.h, height))

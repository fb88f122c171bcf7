"""How heavy lettering is, by the distance of its ink to the ground."""

from __future__ import annotations

import numpy as np

from ..sources.pictures import grey

#: The least width and height of a title's box, the ink's colour distance and brightness, and the shares of ink in the box.
LEAST_BOX, INK_OFF, INK_GREY, INK_SHARE = (80, 28), 65, 190, (0.10, 0.60)
#: A stroke's length in pixels; the pixels in strokes of each direction; the radius of bold strokes and how much two directions may differ.
STROKE, LEAST_INK, LEAST_STROKES, BOLD, RATIO = 11, 300, 100, 1.6, 1.6


#: Stands for the square of a distance to nothing.
NOWHERE = 1 << 30
#: The same where distances are short, and the longest that counts as short: its square and that of a column together stay below 1 << 16.
NOWHERE_NEAR, NEAR = (1 << 15) - 1, 180


def squares_to_ground(mask: np.ndarray) -> np.ndarray:
    """The square of the exact distance of each masked pixel to the nearest one that isn't, NOWHERE or NOWHERE_NEAR (of 16 bits) where there is none: down each column, then by the least sum of squares along each row."""
    h, w = mask.shape
    far = np.where(mask, h, 0).astype(np.uint8 if h <= NEAR else np.int32)  # no column of h pixels has a distance of h
    for y in range(1, h):
        np.minimum(far[y], far[y - 1] + 1, out=far[y])
    for y in range(h - 2, -1, -1):
        np.minimum(far[y], far[y + 1] + 1, out=far[y])
    for kind, nowhere in ((np.uint16, NOWHERE_NEAR), (np.int32, NOWHERE))[h > NEAR :]:
        column = far.astype(kind)
        column *= column
        column[far == h] = nowhere
        best = column.copy()
        most, k = int(best.max(initial=0)), 1
        some = most < nowhere or bool((column < nowhere).any())
        while some and k < w and k * k < most and (k <= NEAR or kind is np.int32):  # columns to both sides, as long as one so far away may be nearer
            near = column + kind(k * k)
            np.minimum(best[:, k:], near[:, :-k], out=best[:, k:])
            np.minimum(best[:, :-k], near[:, k:], out=best[:, :-k])
            most, k = int(best.max()), k + 1
        if not some or k == w or k * k >= most:
            break
    return best


def to_ground(mask: np.ndarray) -> np.ndarray:
    """The exact distance of each masked pixel to the nearest one that isn't, infinite where there is none."""
    best = squares_to_ground(mask)
    return np.where(best < nowhere_of(best), np.sqrt(best, dtype=float), np.inf)


def nowhere_of(squares: np.ndarray) -> int:
    return NOWHERE_NEAR if squares.dtype == np.uint16 else NOWHERE


def along(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """The pixels that lie in a straight run of `size` masked pixels along an axis."""
    if mask.shape[axis] < size:
        return np.zeros_like(mask)
    m = mask if axis == 0 else mask.T
    have, full = 1, m
    while have < size:  # runs from each pixel on, by stretches that double
        more = min(have, size - have)
        full, have = full[:-more] & full[more:], have + more
    have, out = 1, np.zeros((m.shape[0] + size - 1, m.shape[1]), bool)
    out[size - 1 : size - 1 + len(full)] = full
    while have < size:
        more = min(have, size - have)
        out, have = out[:-more] | out[more:], have + more
    return out if axis == 0 else out.T


def middle(squares: np.ndarray) -> float:
    """The median of the roots of whole numbers, by their counts."""
    if int(squares.max()) >= nowhere_of(squares):
        return float(np.median(np.where(squares < nowhere_of(squares), np.sqrt(squares, dtype=float), np.inf)))
    upto, n = np.cumsum(np.bincount(squares)), len(squares)
    low, high = np.searchsorted(upto, ((n - 1) // 2, n // 2), side="right")
    return float((np.sqrt(low) + np.sqrt(high)) / 2)


def stroke_radii(ink: np.ndarray) -> tuple[float, float] | None:
    """The median distance to the ground over long horizontal and over long vertical strokes, if there is enough of both."""
    flat, upright = along(ink, STROKE, 1), along(ink, STROKE, 0)
    if np.count_nonzero(flat) < LEAST_STROKES or np.count_nonzero(upright) < LEAST_STROKES:
        return None
    squares = squares_to_ground(ink)
    return middle(squares[flat]), middle(squares[upright])


def ink_of(crop: np.ndarray, colour: tuple[int, int, int]) -> np.ndarray:
    """Pixels of a colour crop that are near to the ink's colour, and dark."""
    near = np.ones(crop.shape[:2], bool)
    for k, level in enumerate(colour):
        plane = crop[:, :, k]
        near &= (plane >= max(0, level - INK_OFF)) & (plane <= min(255, level + INK_OFF))
    brightest = np.array([[[min(255, level + INK_OFF) for level in colour]]], np.uint8)
    return near if grey(brightest)[0, 0] < INK_GREY else near & (grey(crop) < INK_GREY)  # luma grows with each channel


def weight(crop: np.ndarray, colour: tuple[int, int, int]) -> tuple[float | None, float | None, bool]:
    """(radius of horizontal strokes, of vertical ones, whether the lettering is bold). Boxes that are small, and ink that is scarce, say nothing."""
    if crop.shape[1] < LEAST_BOX[0] or crop.shape[0] < LEAST_BOX[1]:
        return None, None, False
    ink = ink_of(crop, colour)
    n = np.count_nonzero(ink)
    radii = stroke_radii(ink) if n >= LEAST_INK and INK_SHARE[0] <= n / ink.size <= INK_SHARE[1] else None
    if radii is None:
        return None, None, False
    return *radii, min(radii) >= BOLD and max(radii) / min(radii) <= RATIO

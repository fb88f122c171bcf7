"""Filling holes of images from what is around them."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np

from .edges import components, dilated, median

FAR = 1e6


#: Pixels whose weights are made at a time.
CHUNK = 512
#: Fronts move on in steps: a pixel that is reached is farther than the one that it is reached from by the root of a half at least.
STEP = 0.7


def _front(ready: np.ndarray, hole: np.ndarray, wide: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, (distance, slope across, slope down) of each, distances of all) of flat images' holes, in the order in which a front from the rim reaches them.

    The front is at its nearest pixel, of equal ones that of the least place, and goes from there up, left, down and right. A distance follows
    from the nearer known neighbour each way: the upwind solution of |grad T| = 1. A slope is over the known neighbours. All pixels within a
    step go on at once: what they reach lies beyond. rank becomes the place in the order, -1 where the image is known.
    """
    later = len(rank)
    rank[:] = later
    rank[ready] = -1
    t = np.where(ready, 0.0, FAR)
    steps = np.array([-wide, -1, wide, 1])
    rim = np.zeros(later, bool)
    rim[(np.flatnonzero(hole)[:, None] + steps).ravel()] = True
    edge = np.flatnonzero(rim & ready)
    far, order, found, done = t[edge], [], [], 0
    while len(edge):
        now = far < far.min() + STEP
        some = edge[now][np.lexsort((edge[now], far[now]))]
        new = (some[:, None] + steps).ravel()
        new = new[hole[new]]
        new = new[rank[new] == later]
        rank[new[::-1]] = np.arange(done + len(new) - 1, done - 1, -1)  # a pixel is reached by the first that touches it
        new = new[rank[new] == np.arange(done, done + len(new))]
        rank[new] = np.arange(done, done + len(new))
        around = new[:, None] + steps
        known = rank[around] < rank[new][:, None]
        while True:  # distances of one step that rest on others of it
            up, left, down, right = np.where(known, t[around], FAR).T
            a, b = np.minimum(up, down), np.minimum(left, right)
            c = a - b
            both = (a < FAR) & (b < FAR) & (np.abs(c) < 1)
            d = np.where(both, (a + b + np.sqrt(2 - np.where(both, c * c, 0))) / 2, 1 + np.minimum(a, b))
            same = np.array_equal(d, t[new])
            t[new] = d
            if same:
                break
        slope = lambda p, q: np.where(q < FAR, np.where(p < FAR, (q - p) / 2, q - d), np.where(p < FAR, d - p, 0.0))  # noqa: B023, E731
        order.append(new)
        found.append(np.stack([d, slope(left, right), slope(up, down)], 1))
        done += len(new)
        edge, far = np.concatenate([edge[~now], new]), np.concatenate([far[~now], d])
    return np.concatenate(order), np.concatenate(found), t


def _filled(images: Sequence[np.ndarray], masks: Sequence[np.ndarray], radius: int) -> list[np.ndarray]:
    """fast_marching() of images of one depth whose masks have known pixels, and others.

    Holes so far apart that none looks at another's pixels lie on one sheet with their surroundings, and whatever waits for no unfilled pixel is filled at once.
    """
    deep, pad, holes = images[0][0, 0].size, radius + 1, []
    for k, mask in enumerate(masks):
        flat = mask.ravel()
        for *_, places in components(dilated(mask, radius // 2)):
            y, x = np.divmod(places[flat[places]], mask.shape[1])
            holes.append((k, y, x, int(y[0]) - pad, int(x.min()) - pad, int(y[-1] - y[0]) + 1 + 2 * pad, int(np.ptp(x)) + 1 + 2 * pad))
    wide = max(*(part[6] for part in holes), int(sum(part[5] * part[6] for part in holes) ** 0.5))
    spots, top, left, below = [(0, 0)] * len(holes), 0, 0, 0
    for k in sorted(range(len(holes)), key=lambda k: -holes[k][5]):  # in rows, the highest first
        if left + holes[k][6] > wide:
            top, left = below, 0
        spots[k], below, left = (top, left), max(below, top + holes[k][5]), left + holes[k][6]
    hole, ready = np.zeros((2, below, wide), bool)
    values = np.zeros((below, wide, deep + (deep == 3)))  # rows of 32 bytes are looked up faster
    own = []
    for (k, y, x, y0, x0, high, broad), (top, left) in zip(holes, spots, strict=True):
        image, known = images[k], ~masks[k]
        y1, x1 = max(0, y0), max(0, x0)
        box = known[y1 : y0 + high, x1 : x0 + broad]
        at = slice(top + y1 - y0, top + y1 - y0 + box.shape[0]), slice(left + x1 - x0, left + x1 - x0 + box.shape[1])
        ready[at], values[at][..., :deep] = box, image[y1 : y0 + high, x1 : x0 + broad].reshape(*box.shape, deep)
        own.append((y + (top - y0)) * wide + (x + (left - x0)))
        hole.ravel()[own[-1]] = True
    hole, values, rank = hole.ravel(), values.reshape(-1, values.shape[2]), np.empty(hole.size, np.int64)
    order, found, level = _front(ready.ravel(), hole, wide, rank)
    # the disc around a pixel: places from it, unit vectors, inverse squares of distances
    oy, ox = (v.ravel() for v in np.mgrid[-radius : radius + 1, -radius : radius + 1])
    disc = (oy**2 + ox**2 <= radius**2) & ((oy != 0) | (ox != 0))
    oy, ox = oy[disc], ox[disc]
    place, far = oy * wide + ox, np.hypot(oy, ox)
    uy, ux, near = oy / far, ox / far, 1 / far**2
    n = len(order)
    rank[rank > n] = n
    waits = np.full(n + 2, 1 << 60)  # for how many pixels each one waits; the last two stand for places beyond the image and known ones
    for begin in range(0, n, CHUNK):
        at = rank.take(order[begin : begin + CHUNK, None] + place)
        waits[begin : begin + len(at)] = np.count_nonzero((at >= 0) & (at < np.arange(begin, begin + len(at))[:, None]), axis=1)
    free, seen, portions = np.flatnonzero(waits[:n] == 0), np.empty(n, np.int64), []
    while len(free):
        portions.append(free)
        later = rank.take(order[free, None] + place).ravel()
        np.subtract.at(waits, later, 1)  # those that came before go below nothing, and wait no more
        later = later[waits[later] == 0]
        seen[later] = np.arange(len(later))
        free = later[seen[later] == np.arange(len(later))]
    least = np.full((min(n, CHUNK), len(place)), 1e-6)
    after, ends = np.concatenate(portions), np.cumsum([len(p) for p in portions]).tolist()
    for begin in range(0, n, CHUNK):
        some = after[begin : begin + CHUNK]
        at = order[some]
        around = at[:, None] + place
        d, gx, gy = (c[:, None] for c in found[some].T)
        weight = ux * gx
        weight += uy * gy
        np.abs(weight, out=weight)
        np.maximum(weight, least[: len(weight)], out=weight)
        weight *= near
        weight *= rank.take(around) < some[:, None]  # a pixel is made of those that were known or came before it
        off = level.take(around)
        off -= d
        np.abs(off, out=off)
        off += 1
        weight /= off
        total, weight = weight.sum(1)[:, None], weight[:, None]
        first, last = bisect.bisect_right(ends, begin), bisect.bisect_left(ends, begin + len(some))
        stops = [0, *(e - begin for e in ends[first:last]), len(some)]
        for i, j in zip(stops, stops[1:], strict=False):
            values[at[i:j]] = (weight[i:j] @ values.take(around[i:j], 0))[:, 0] / total[i:j]
    out = [image.copy() for image in images]
    for (k, y, x, *_), at in zip(holes, own, strict=True):
        out[k][y, x] = np.floor(values[at, :deep] + 0.5).reshape(len(at), *images[k].shape[2:]).astype(images[k].dtype)
    return out


def fast_marching_all(images: Sequence[np.ndarray], masks: Sequence[np.ndarray], radius: int = 4) -> list[np.ndarray]:
    """Each image with its masked pixels filled, those nearest to the rim first.

    A pixel is the mean of the known ones within radius, weighted by how much they lie along the front's direction, by
    the inverse square of their distance, and by how near they are to the pixel's own level of distance from the rim.
    Holes of any depth are filled; an image without a known pixel stays as it is.
    """
    masks = [m.astype(bool) for m in masks]
    kinds: dict[tuple, list[int]] = {}
    for k, (image, mask) in enumerate(zip(images, masks, strict=True)):
        if mask.any() and not mask.all():
            kinds.setdefault(image.shape[2:], []).append(k)
    out = list(images)
    for which in kinds.values():
        for k, filled in zip(which, _filled([images[k] for k in which], [masks[k] for k in which], radius), strict=True):
            out[k] = filled
    return [o.copy() if o is image else o for o, image in zip(out, images, strict=True)]


def fast_marching(image: np.ndarray, mask: np.ndarray, radius: int = 4) -> np.ndarray:
    """fast_marching_all() of one image."""
    return fast_marching_all([image], [mask], radius)[0]


def _flattened(image: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image with holes in flat surroundings filled by those' median, mask of the others)."""
    out, textured = image.copy(), mask.copy()
    for x1, y1, x2, y2, _, places in components(mask):
        pad = max(4, min(12, (y2 - y1) // 3))
        box = slice(max(0, y1 - pad), y2 + pad), slice(max(0, x1 - pad), x2 + pad)
        around, known = image[box].reshape(*mask[box].shape, -1), ~mask[box]
        ring = [around[..., k][known] for k in range(around.shape[2])]
        if len(ring[0]) < 16:
            continue
        middle = [median(r) for r in ring]
        off = sum((2 * r.astype(np.int32) - int(2 * m)) ** 2 for r, m in zip(ring, middle, strict=True))  # of doubles, since a median may lie between two levels
        if np.count_nonzero(off < (2 * 22) ** 2) / len(off) >= 0.78:
            ys, xs = np.divmod(places, mask.shape[1])
            out[ys, xs] = np.array(middle).astype(np.uint8).reshape(image.shape[2:])
            textured[ys, xs] = False
    return out, textured


def cleaned_all(images: Sequence[np.ndarray], masks: Sequence[np.ndarray], radius: int = 4) -> list[tuple[np.ndarray, int]]:
    """(image without what the mask covers, pixels that were painted by the front) of each: flat surroundings give their median, others go on by fast_marching()."""
    made = [_flattened(image, mask.astype(bool)) for image, mask in zip(images, masks, strict=True)]
    painted = fast_marching_all([out for out, _ in made], [textured for _, textured in made], radius)
    return [(p, int(np.count_nonzero(textured))) for p, (_, textured) in zip(painted, made, strict=True)]


def cleaned(image: np.ndarray, mask: np.ndarray, radius: int = 4) -> tuple[np.ndarray, int]:
    """cleaned_all() of one image."""
    return cleaned_all([image], [mask], radius)[0]

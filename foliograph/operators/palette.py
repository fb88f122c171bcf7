"""Palettes of images: clusters of their colours, of many images at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pictures import per_image, spread, whole_pages

#: Pixels of an image that are looked at, evenly spaced; tries from other starts; steps of a try, and the move of a centre that ends it.
SAMPLES, ATTEMPTS, STEPS, STILL = 12_000, 3, 30, 0.2
SEED = 5
#: Clusters at most.
MOST = 6
CHANNELS = ("r", "g", "b")


def colours(images: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(page_id, rgb, n): how many of the evenly spaced pixels of each image have each colour."""

    def of(image: np.ndarray) -> dict:
        p = image.reshape(-1, 3)
        p = p[:: max(1, len(p) // samples)].astype(np.int64)
        kinds, n = np.unique(p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2], return_counts=True)
        return {"rgb": kinds, "n": n}

    return per_image(images, [("rgb", pa.int64()), ("n", pa.int64())], of)


def chance(page: Column, attempt: Column, k: int, seed: int = SEED) -> Column:
    """A number from 0 to 1 that is the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), page, attempt, F.lit(k)), F.lit(1 << 52)) / float(1 << 52)


class _Tries:
    """All tries of some pages at once: a row is a colour in a try, rows of a try lie side by side, and so do the tries of a page."""

    def __init__(self, sizes: np.ndarray, rgb: np.ndarray, n: np.ndarray, chances: np.ndarray) -> None:
        """sizes: how many of the colours (rgb, n) each page has; chances[page, try, k]."""
        self.attempts, self.chances = chances.shape[1], chances.reshape(-1, MOST)
        ends = np.repeat(np.cumsum(sizes), self.attempts)
        sizes = np.repeat(sizes, self.attempts)
        self.first = np.cumsum(sizes) - sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        take = np.arange(len(self.of)) + np.repeat(ends - sizes - self.first, sizes)
        rgb, self.n = rgb[take], n[take]
        self.at = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], 1).astype(float)
        self.k = np.minimum(np.clip(np.add.reduceat(self.n, self.first) // 1000, 2, MOST), sizes)
        self.centres = np.full((len(sizes), MOST, 3), np.inf)  # one that isn't there is nearest to nothing

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest centre, the first of equals, and its squared distance."""
        to = sum((self.centres[self.of[rows], :, c] - self.at[rows, None, c]) ** 2 for c in range(3))
        i = to.argmin(1)
        return i, to[np.arange(len(rows)), i]

    def start(self) -> None:
        """Colours far from those before them: each with a chance in proportion to its pixels times its squared distance."""
        for k in range(MOST):
            rows = np.flatnonzero(self.k[self.of] > k)
            w = np.zeros(len(self.of), np.int64)
            w[rows] = self.n[rows] * self.nearest(rows)[1].astype(np.int64) if k else self.n[rows]
            upto = np.cumsum(w)
            upto -= (upto - w)[self.first][self.of]
            hit = np.flatnonzero((w > 0) & (upto > (self.chances[:, k] * np.add.reduceat(w, self.first))[self.of]))
            tries, nth = np.unique(self.of[hit], return_index=True)
            self.centres[tries, k] = self.at[hit[nth]]

    def move(self, steps: int) -> None:
        """Centres to the means of the pixels nearest to them, until none of a try moves by more than STILL."""
        moves, centres = np.ones(len(self.first), bool), self.centres.reshape(-1, 3)
        for _ in range(steps):
            rows = np.flatnonzero(moves[self.of])
            if not len(rows):
                return
            own, n = self.of[rows] * MOST + self.nearest(rows)[0], self.n[rows]
            total = np.bincount(own, n, len(centres))
            some = np.flatnonzero(total)
            mean = np.stack([np.bincount(own, n * self.at[rows, c], len(centres))[some] / total[some] for c in range(3)], 1)
            by = sum((centres[some, c] - mean[:, c]) ** 2 for c in range(3))
            centres[some], moves[:] = mean, False
            moves[some[by > STILL * STILL] // MOST] = True

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(page, nth, centre, pixels) of the try of each page whose pixels are nearest, counted in thousandths; the centres with the most pixels first."""
        i, d2 = self.nearest(np.arange(len(self.of)))
        off = self.n * d2 * 1000
        off = np.floor(off).astype(np.int64) + (off - np.floor(off) >= 0.5)
        best = np.add.reduceat(off, self.first).reshape(-1, self.attempts).argmin(1)
        n = np.bincount(self.of * MOST + i, self.n, self.centres.size // 3).astype(np.int64).reshape(-1, self.attempts, MOST)
        n = np.take_along_axis(n, best[:, None, None], 1)[:, 0]
        page, c = np.nonzero(n)
        order = np.lexsort((c, -n[page, c], page))
        page, c = page[order], c[order]
        first = np.searchsorted(page, page)
        return page, np.arange(len(page)) - first + 1, self.centres[page * self.attempts + best[page], c], n[page, c]


def clusters(found: DataFrame, attempts: int = ATTEMPTS, steps: int = STEPS) -> DataFrame:
    """(page_id, nth, r, g, b, n): the clusters of each image's colours (page_id, rgb, n), the largest first.

    Two to six, one for each thousand pixels. A try starts from colours that are chosen far from those before them, and
    moves centres to the mean of the pixels nearest to them until none moves by more than STILL; of the tries the one
    whose pixels are nearest to their centres counts. Pixels of one colour are one row from the start. Sums of colours
    are of whole numbers, so the order of rows makes no difference.

    Colours are shuffled once, by page. A task goes through its pages as many at a time as an Arrow batch holds: what it
    holds is a batch and one page's colours.
    """

    def of(rows: pa.Table) -> pa.RecordBatch:
        ids, rgb, n = (rows[c].to_numpy() for c in ("page_id", "rgb", "n"))
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        chances = pc.list_flatten(rows["chances"].take(pa.array(first))).to_numpy().reshape(len(first), attempts, MOST)
        tries = _Tries(np.diff(np.r_[first, len(ids)]), rgb, n, chances)
        tries.start()
        tries.move(steps)
        page, nth, centres, pixels = tries.best()
        return pa.RecordBatch.from_arrays([pa.array(ids[first[page]]), pa.array(nth, pa.int32()), *(pa.array(centres[:, c]) for c in range(3)), pa.array(pixels)], names=["page_id", "nth", *CHANNELS, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(of, whole_pages(batches))

    rows = spread(found.where("page_id IS NOT NULL AND n > 0").select(*(F.col(c).cast("long") for c in ("page_id", "rgb", "n"))), "page_id").sortWithinPartitions("page_id", "rgb")
    chances = F.array(*(chance(F.col("page_id"), F.lit(a), k) for a in range(1, attempts + 1) for k in range(MOST)))
    return rows.withColumn("chances", chances).mapInArrow(run, "page_id bigint, nth int, r double, g double, b double, n bigint")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))).cast("int")), 2, "0") for c in (r, g, b)))


def palette(made: DataFrame) -> DataFrame:
    """(page_id, primary, secondary, accent, dark, last, clusters) as hex colours; accent has the widest range of channels, dark the least mean."""
    r, g, b = (F.col(c) for c in CHANNELS)
    one = made.withColumns({"hex": hex_of(r, g, b), "range": F.greatest(r, g, b) - F.least(r, g, b), "mean": (r + g + b) / 3})
    nth = lambda k: F.max(F.when(F.col("nth") == k, F.col("hex")))
    return one.groupBy("page_id").agg(
        nth(1).alias("primary"), F.coalesce(nth(2), nth(1)).alias("secondary"), F.max_by("hex", F.struct("range", -F.col("nth"))).alias("accent"), F.min_by("hex", F.struct("mean", "nth")).alias("dark"), F.max_by("hex", "nth").alias("last"), F.count("*").alias("clusters"),
    )

"""Operators on grey tiles held as pixel rows: page_id, px, py, v."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pictures import whole_pages
from . import graph

STEPS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels at one place of two tiles: v and w."""
    return a.join(b.withColumnRenamed("v", "w"), ["page_id", "px", "py"])


def similarity(diff2: Column) -> Column:
    """1 / (1 + mean squared error / 255^2)."""
    return 1 / (1 + F.avg(diff2) / (255.0 * 255.0))


def masked_mean(value: Column, mask: Column, empty: float) -> Column:
    return F.coalesce(F.avg(F.when(mask, value)), F.lit(empty))


def neighbourhood(df: DataFrame, value: Column) -> DataFrame:
    """(page_id, px, py, value) nine times: each pixel's value at its own place and at its neighbours' places."""
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in STEPS))
    return df.select("page_id", (F.col("px")).alias("x"), (F.col("py")).alias("y"), value.alias("value"), F.explode(offsets).alias("o")).select("page_id", (F.col("x") + F.col("o.dx")).alias("px"), (F.col("y") + F.col("o.dy")).alias("py"), "value")


def dilated(df: DataFrame, mask: Column) -> DataFrame:
    """(page_id, px, py) of places with a masked pixel in their 3 x 3 surroundings."""
    spread = neighbourhood(df.where(mask), F.lit(1)).select("page_id", "px", "py").distinct()
    return spread.join(df.select("page_id", "px", "py"), ["page_id", "px", "py"], "left_semi")


def eroded(df: DataFrame, mask: Column) -> DataFrame:
    """(page_id, px, py) of masked pixels all of whose neighbours on the tile are masked."""
    out = dilated(df, ~mask)
    return df.where(mask).select("page_id", "px", "py").join(out, ["page_id", "px", "py"], "left_anti")


def runs(df: DataFrame, mask: Column) -> DataFrame:
    """(page_id, py, first, last): runs of masked pixels in a row."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id", "py").orderBy("px")
    numbered = df.where(mask).withColumn("island", F.col("px") - F.row_number().over(w))
    return numbered.groupBy("page_id", "py", "island").agg(F.min("px").alias("first"), F.max("px").alias("last")).drop("island")


def _labels(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For pixels in scan order the number of the first pixel that each hangs together with."""
    wide = int(cols.max()) + 3
    key = rows.astype(np.int64) * wide + cols + 1
    a, b = [], []
    for step in (1, wide - 1, wide, wide + 1):  # to the right, and the three below
        at = np.searchsorted(key, key + step)
        hit = np.flatnonzero((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step))
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(key))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b], a, b):
            np.minimum.at(root, side, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def components(df: DataFrame, mask: Column) -> DataFrame:
    """(page_id, px, py, label): 8-connected components; the label is the least place, py * 1000000 + px, of the component.

    Pages are dealt over tasks and labelled many at a time, as many as an Arrow batch holds, by array operations in a
    number of rounds that grows with the logarithm of a component's reach; what a task holds is a batch and one page,
    which an image's size bounds. run_components() spreads one image over tasks.
    """

    def labelled(pages: pd.DataFrame) -> pd.DataFrame:
        py, px = pages["py"].to_numpy(np.int64), pages["px"].to_numpy(np.int64)
        own = pd.factorize(pages["page_id"])[0] * (py.max() + 3)  # a free row between pages, so none touch
        root = _labels(own + py, px)
        return pages.assign(label=py[root] * 1_000_000 + px[root])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(rows):
                open_ = (rows["page_id"] == rows["page_id"].iloc[-1]).to_numpy()  # may go on in the next batch
                held = rows[open_]
                if not open_.all():
                    yield labelled(rows[~open_])
        if held is not None:
            yield labelled(held)

    places = df.where(mask).select("page_id", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"))
    return places.repartition("page_id").sortWithinPartitions("page_id", "py", "px").mapInPandas(run, "page_id bigint, px int, py int, label bigint")


def run_components(df: DataFrame, mask: Column) -> DataFrame:
    """(page_id, py, first, last, label): components() for images of any size, over runs of pixels instead of pixels.

    Runs of neighbouring rows that touch are edges of a graph whose components are found by joins; the label is the
    component's first run in scan order.
    """
    r = runs(df, mask).withColumn("node", F.struct("page_id", "py", "first"))
    below = r.select("page_id", (F.col("py") - 1).alias("py"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("node").alias("other"))
    edges = r.join(below, ["page_id", "py"]).where("first <= l + 1 AND f <= last + 1").select("node", "other")
    roots = graph.components(edges, "node", "other").withColumnRenamed("root", "top")
    label = F.coalesce("top", "node")
    return r.join(roots, "node", "left").select("page_id", "py", "first", "last", (label["py"] * 1_000_000 + label["first"]).cast("long").alias("label"))


#: A level is counted in so many parts.
PARTS = 10**9


def _ring(key: np.ndarray, wide: int, level: np.ndarray, known: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The missing rows with a known one in the 3 x 3 places around theirs, and the mean of these, halves upwards. key: a row's place, of which neighbours lie 1 and wide apart."""
    places, of = np.unique(key[known], return_inverse=True)
    total, count = np.zeros(len(places), np.int64), np.bincount(of, minlength=len(places))
    np.add.at(total, of, level[known])
    sums, counts = np.zeros((2, len(missing)), np.int64)
    for step in (dy * wide + dx for dx, dy in STEPS):
        at = np.minimum(np.searchsorted(places, key[missing] + step), len(places) - 1)
        hit = places[at] == key[missing] + step
        sums += np.where(hit, total[at], 0)
        counts += np.where(hit, count[at], 0)
    made = counts > 0
    return missing[made], (2 * sums[made] + counts[made]) // (2 * counts[made])


def inpainted(p: DataFrame, mask: str, rounds: int = 3) -> DataFrame:
    """(page_id, px, py, x): masked pixels from the mean of the known ones around them, ring by ring; what no ring reaches stays null.

    Pixels are shuffled once, by page, and a task makes all rings of as many pages at a time as an Arrow batch holds; what
    it holds is a batch and one page. Means are of whole billionths, so the order of rows makes no difference.
    """

    def of(pages: pa.Table) -> pa.Table:
        page, px, py = (pages[c].combine_chunks() for c in ("page_id", "px", "py"))
        x = pages["x"].combine_chunks()
        placed = np.logical_and.reduce([c.is_valid().to_numpy(False) for c in (page, px, py)])
        known = x.is_valid().to_numpy(False)
        level = np.rint(x.fill_null(0).to_numpy(False) * PARTS).astype(np.int64)
        ids, across, down = (c.fill_null(0).to_numpy(False).astype(np.int64) for c in (page, px, py))
        across, down = across - across.min(), down - down.min()
        wide, high = int(across.max()) + 2, int(down.max()) + 2  # a free column between rows and a free row between pages, so none touch
        nth = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])
        key = (nth * high + down) * wide + across
        missing = np.flatnonzero(placed & ~known)
        filled = np.zeros(len(key), bool)
        for _ in range(rounds):
            have = np.flatnonzero(placed & (known | filled))
            if not len(missing) or not len(have):
                break
            some, mean = _ring(key, wide, level, have, missing)
            level[some], filled[some] = mean, True
            missing = missing[~filled[missing]]
        out = np.where(filled, level / PARTS, x.fill_null(0).to_numpy(False))
        return pa.table({"page_id": page, "px": px, "py": py, "x": pa.array(out, mask=~(known | filled))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in whole_pages(batches):
            yield from of(pages).to_batches()

    rows = p.select("page_id", "px", "py", F.when(~F.expr(mask), F.col("v").cast("double")).alias("x"))
    ordered = rows.repartition("page_id").sortWithinPartitions("page_id", "py", "px")
    return ordered.mapInArrow(run, rows.schema)


def composite(below: Column, above: Column, alpha: Column) -> Column:
    """Source over ground, alpha from 0 to 1."""
    return above * alpha + below * (1 - alpha)

"""Joins of layout tables on a page: pairs, containment, nearest, coverage, ownership, versions.

Every join has the page as an equi key, so a page's rows meet in one partition and pages spread over the cluster;
predicates on boxes are residuals of that join. overlapping() is for pages with very many boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut


def prefixed(df: DataFrame, prefix: str, page: str = "page_id") -> DataFrame:
    return df.select(page, *(F.col(c).alias(prefix + c) for c in df.columns if c != page))


def pairs(a: DataFrame, b: DataFrame | None = None, on: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows a_* and b_* of one page; of a table with itself each pair once, the earlier position first."""
    on = on if on is not None else F.lit(True)
    if b is None:
        b, on = a, on & (F.col("a_pos") < F.col("b_pos"))
    right = prefixed(b, "b_").withColumnRenamed("page_id", "b_page")
    return prefixed(a, "a_").join(right, (F.col("page_id") == F.col("b_page")) & on, how).drop("b_page")


def best(df: DataFrame, key: list[str], order: Column, **take: Column) -> DataFrame:
    """For each key the values at the least order; order must have no ties."""
    least = F.min(F.struct(order.alias("o"), *(c.alias(n) for n, c in take.items())))
    return df.groupBy(*key).agg(least.alias("m")).select(*key, *(F.col("m")[n].alias(n) for n in take))


def relations(elements: DataFrame) -> DataFrame:
    """(page_id, a_pos, b_pos, kind, confidence): contains, else near; and aligned on an axis."""
    a, b = G.box("a_"), G.box("b_")
    p = pairs(elements)
    inside = (G.coverage(b, a) >= 0.98) | (G.coverage(a, b) >= 0.98)
    scale = F.greatest(F.least(a.w, a.h, b.w, b.h), F.lit(1.0))
    (ax, ay), (bx, by) = G.center(a), G.center(b)
    near, level, upright = G.gap(a, b) <= 1.4 * scale, F.abs(ax - bx) <= 4, F.abs(ay - by) <= 4
    p = p.where(inside | near | level | upright)  # most pairs have no relation, so none is made for them
    kinds = F.array(
        F.when(inside, F.struct(F.lit("contains").alias("kind"), F.lit(0.78).alias("confidence"))).when(near, F.struct(F.lit("near").alias("kind"), F.lit(0.55).alias("confidence"))),
        F.when(level, F.struct(F.lit("x_aligned").alias("kind"), F.lit(0.62).alias("confidence"))),
        F.when(upright, F.struct(F.lit("y_aligned").alias("kind"), F.lit(0.62).alias("confidence"))),
    )
    return p.select("page_id", "a_pos", "b_pos", F.explode(F.array_compact(kinds)).alias("r")).select("page_id", "a_pos", "b_pos", "r.*")


def containers(elements: DataFrame, kind: str = "rectangle") -> DataFrame:
    """(page_id, pos, container): the last box of a kind that holds an element whole."""
    a, b = G.box("a_"), G.box("b_")
    holds = (b.x1 >= a.x1) & (b.y1 >= a.y1) & (b.x2 <= a.x2) & (b.y2 <= a.y2) & (F.col("a_pos") != F.col("b_pos"))
    p = pairs(elements.where(F.col("type") == kind), elements, holds)
    return best(p, ["page_id", "b_pos"], -F.col("a_pos"), container=F.col("a_pos")).withColumnRenamed("b_pos", "pos")


def nearest(a: DataFrame, b: DataFrame, on: Column | None = None) -> DataFrame:
    """(page_id, a_pos, b_pos, distance2): for each a the b with the nearest centre, the first of equals."""
    (ax, ay), (bx, by) = G.center(G.box("a_")), G.center(G.box("b_"))
    d = (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    p = pairs(a, b, on)
    return best(p, ["page_id", "a_pos"], F.struct(d.alias("d"), F.col("b_pos").alias("p")), b_pos=F.col("b_pos"), distance2=d)


#: Rows of a page and value up to which they are compared with each other at once.
FEW = 32


def nearest_in_rings(a: DataFrame, b: DataFrame, same: str, cell: float = 64.0) -> DataFrame:
    """(page_id, a_pos, b_pos, distance2, looked): nearest() among rows with the same value of `same` and another pos, through a grid.

    A row looks into its own cell and the ones around it, then into rings that widen, and is done when its best is
    nearer than any cell it hasn't looked into, or when no cell of its page and value is left. looked counts the rows it
    compared. A page of many rows costs what its dense places cost, not its pairs; each round is stored. Where a page and
    value have FEW rows and less, nearly all cells of a ring are empty, so a row meets those few without a grid.
    """
    centre = lambda p: G.center(G.box(p))
    (ax, ay), (bx, by) = centre("a_"), centre("b_")
    left, right = (prefixed(d.select("page_id", "pos", "x1", "y1", "x2", "y2", same), p).withColumnRenamed(f"{p}{same}", same) for d, p in ((a, "a_"), (b, "b_")))
    left = left.select("page_id", "a_pos", same, ax.alias("ax"), ay.alias("ay"))
    right = right.select("page_id", "b_pos", same, bx.alias("bx"), by.alias("by"))
    at = lambda c: F.floor(F.col(c) / cell)
    d = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)
    closest = F.min(F.struct(d.alias("d"), F.col("b_pos").alias("p")))
    right = right.withColumns({"cx": at("bx"), "cy": at("by")})
    sizes = cut(right.groupBy("page_id", same).agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in ("cx", "cy") for n, f in (("lo", F.min), ("hi", F.max)))))
    few, many = (sizes.where(F.col("rows") <= FEW).select("page_id", same), sizes.where(F.col("rows") > FEW).drop("rows"))
    met = left.join(right.drop("cx", "cy").join(few, ["page_id", same], "left_semi"), ["page_id", same]).where("a_pos <> b_pos")
    done = met.groupBy("page_id", "a_pos").agg(closest.alias("m"), F.count("*").alias("looked")).select("page_id", "a_pos", F.col("m.p").alias("b_pos"), F.col("m.d").alias("distance2"), "looked")
    if many.isEmpty():
        return done
    right = cut(right.join(many.select("page_id", same), ["page_id", same], "left_semi"))
    start = left.join(many, ["page_id", same])
    last = F.greatest(*(F.abs(at(c) - F.col(f"{n}_{g}")) for c, g in (("ax", "cx"), ("ay", "cy")) for n in ("lo", "hi")))
    none = "struct<d:double,p:int>"
    open_ = cut(start.select("page_id", "a_pos", same, "ax", "ay", last.alias("last"), F.lit(None).cast(none).alias("best"), F.lit(0).cast("long").alias("looked")))
    inner, outer = -1, 1
    while True:
        square = lambda r: F.sequence(F.lit(-r), F.lit(r))
        cells = open_.select("page_id", same, "a_pos", "ax", "ay", F.explode(square(outer)).alias("dx")).withColumn("dy", F.explode(square(outer)))
        ring = cells.where(F.greatest(F.abs("dx"), F.abs("dy")) > inner).select("page_id", same, "a_pos", "ax", "ay", (at("ax") + F.col("dx")).alias("cx"), (at("ay") + F.col("dy")).alias("cy"))
        met = ring.join(right, ["page_id", same, "cx", "cy"]).where("a_pos <> b_pos")
        found = met.groupBy("page_id", "a_pos").agg(closest.alias("new"), F.count("*").alias("n"))
        # a row outside of the square is at least as far as the nearest side of the square
        side = F.least(*(F.least(F.col(c) - at(c) * cell, (at(c) + 1) * cell - F.col(c)) for c in ("ax", "ay"))) + outer * cell
        best = F.when(F.col("new").isNull(), F.col("best")).when(F.col("best").isNull(), F.col("new")).otherwise(F.least("best", "new"))
        now = open_.join(found, ["page_id", "a_pos"], "left").withColumns({"best": best, "looked": F.col("looked") + F.coalesce("n", F.lit(0))})
        ended = (F.col("best.d") < side * side) | (F.col("last") <= outer)
        now = cut(now.withColumn("ended", F.coalesce(ended, F.lit(False))).drop("new", "n"))
        out = now.where("ended AND best IS NOT NULL").select("page_id", "a_pos", F.col("best.p").alias("b_pos"), F.col("best.d").alias("distance2"), "looked")
        done = done.unionByName(out)
        open_ = now.where("NOT ended").drop("ended")
        if open_.isEmpty():
            return done
        inner, outer = outer, 2 * outer


def snapped(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, a_pos, b_pos, score): the region that a box snaps to, by overlap times confidence."""
    a, b = G.box("a_"), G.box("b_")
    ratio = G.area(b) / G.area(a)
    p = pairs(boxes, regions, ratio.between(0.2, 5.0) & (G.overlap_min(a, b) >= 0.30))
    score = G.overlap_min(a, b) * F.col("b_confidence")
    return best(p, ["page_id", "a_pos"], F.struct((-score).alias("s"), F.col("b_pos").alias("p")), b_pos=F.col("b_pos"), score=score)


def smallest_owner(texts: DataFrame, assets: DataFrame, share: float = 0.75) -> DataFrame:
    """(page_id, a_pos, b_pos): the smallest asset that covers so much of a text."""
    a, b = G.box("a_"), G.box("b_")
    p = pairs(texts, assets, G.coverage(a, b) >= share)
    return best(p, ["page_id", "a_pos"], F.struct(G.area(b).alias("s"), F.col("b_pos").alias("p")), b_pos=F.col("b_pos"))


def covered(a: DataFrame, b: DataFrame, share: float, how: str = "left_semi") -> DataFrame:
    """The rows of a of which a b of the page covers so much; or, with left_anti, the others."""
    right = b.select(F.col("page_id").alias("b_page"), *(F.col(c).alias(f"b_{c}") for c in ("pos", "x1", "y1", "x2", "y2")))
    return a.join(right, (F.col("page_id") == F.col("b_page")) & (F.col("pos") != F.col("b_pos")) & (G.coverage(G.box(), G.box("b_")) >= share), how)


def covering(a: DataFrame, b: DataFrame, share: float, how: str = "left_semi") -> DataFrame:
    """The rows of a that cover so much of a b of the page; or, with left_anti, the others."""
    right = b.select(F.col("page_id").alias("b_page"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    return a.join(right, (F.col("page_id") == F.col("b_page")) & (G.coverage(G.box("b_"), G.box()) >= share), how)


def overlapping(a: DataFrame, b: DataFrame, cell: float = 96.0) -> DataFrame:
    """Pairs whose insides meet, through a grid: rows meet in the cells that both touch, and count in the first of those."""

    def cells(c: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(f"{c}1") / cell), F.floor(F.col(f"{c}2") / cell)))

    def gridded(df: DataFrame, prefix: str) -> DataFrame:
        p = prefixed(df, prefix)
        return p.withColumn("cx", cells(f"{prefix}x")).withColumn("cy", cells(f"{prefix}y"))

    x, y = G.box("a_"), G.box("b_")
    met = gridded(a, "a_").join(gridded(b, "b_"), ["page_id", "cx", "cy"])
    first = (F.col("cx") == F.floor(F.greatest(x.x1, y.x1) / cell)) & (F.col("cy") == F.floor(F.greatest(x.y1, y.y1) / cell))
    return met.where(G.intersects(x, y) & first).drop("cx", "cy")


def reconciled(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, pos, status) of a page's rows in two versions: kept, changed, lost, added."""
    was = before.select("page_id", "pos", F.struct("x1", "y1", "x2", "y2", "type").alias("was"))
    now = after.select("page_id", "pos", F.struct("x1", "y1", "x2", "y2", "type").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "lost").when(F.col("was") == F.col("now"), "kept").otherwise("changed")
    return was.join(now, ["page_id", "pos"], "full").select("page_id", "pos", status.alias("status"))

"""Rules whose next decision depends on all decisions before it on the page, as folds over the page's rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.binding import let
from . import relations as R
from .sequence import ordered


def _assigned(pages: DataFrame, state: str, step, label: str) -> DataFrame:
    """(page_id, pos, label): step(state, row, i) gives the new state, whose `of` ends with the row's block."""
    start = F.from_json(F.lit("{}"), state)
    out = F.aggregate(F.arrays_zip("rows", F.sequence(F.lit(0), F.size("rows") - 1).alias("i")), start, lambda acc, x: step(acc, x["rows"]))
    return pages.select("page_id", F.explode(F.arrays_zip(F.col("rows"), out["of"].alias("of"))).alias("x")).select("page_id", F.col("x.rows.pos").alias("pos"), F.col("x.of").alias(label))


def _merged(lines: DataFrame, order: list[str], fits, last: int) -> DataFrame:
    """(page_id, pos, block): a line joins the latest of the last open blocks that fits(block, line), which then holds both; else it opens one."""
    box = "x1:double,y1:double,x2:double,y2:double,role:string"
    pages = ordered(lines, order, [c for c in ("x1", "y1", "x2", "y2", "role") if c not in order])

    def step(acc: Column, r: Column) -> Column:
        blocks = F.coalesce(acc["blocks"], F.array().cast(f"array<struct<{box}>>"))
        n = F.size(blocks)
        # the latest first: positions n - 1 down to n - last
        open_ = F.filter(F.sequence(F.lit(1), F.lit(last)), lambda j: (j <= n) & F.coalesce(fits(F.get(blocks, n - j), r), F.lit(False)))
        wide = lambda b: F.struct(F.least(b["x1"], r["x1"]).alias("x1"), F.least(b["y1"], r["y1"]).alias("y1"), F.greatest(b["x2"], r["x2"]).alias("x2"), F.greatest(b["y2"], r["y2"]).alias("y2"), b["role"].alias("role"))
        fresh = F.struct(*(r[c].alias(c) for c in ("x1", "y1", "x2", "y2", "role")))

        def joined(at: Column) -> Column:
            grown = F.when(at.isNull(), F.concat(blocks, F.array(fresh))).otherwise(F.transform(blocks, lambda b, k: F.when(k == at, wide(b)).otherwise(b)))
            return F.struct(grown.alias("blocks"), F.concat(F.coalesce(acc["of"], F.array().cast("array<int>")), F.array(F.coalesce(at, n))).alias("of"))

        return let(n - F.get(open_, F.lit(0)), joined)

    return _assigned(pages, f"blocks array<struct<{box}>>, of array<int>", step, "block")


def merged_lines(lines: DataFrame, last: int = 8) -> DataFrame:
    """Paragraphs: a line goes on a block of its role that ends a little above it, and overlaps it by a fifth or begins near its edge."""

    def fits(b: Column, r: Column) -> Column:
        high = r["y2"] - r["y1"]
        gap, shared = r["y1"] - b["y2"], F.least(r["x2"], b["x2"]) - F.greatest(r["x1"], b["x1"])
        beside = (shared > 0.2 * F.least(r["x2"] - r["x1"], b["x2"] - b["x1"])) | (F.abs(b["x1"] - r["x1"]) <= F.greatest(F.lit(18.0), 1.4 * high))
        return (b["role"] == r["role"]) & (gap >= -0.25 * high) & (gap <= F.greatest(F.lit(10.0), 0.9 * high)) & beside

    return _merged(lines, ["pos"], fits, last)


def same_lines(lines: DataFrame, last: int = 8) -> DataFrame:
    """Lines: a piece goes on a line of its role and about its height and middle that ends a little left of it; over wider gaps the sizes have to agree."""

    def fits(b: Column, r: Column) -> Column:
        bh, rh = b["y2"] - b["y1"], r["y2"] - r["y1"]
        most, ratio = F.greatest(bh, rh), F.greatest(bh, rh) / F.greatest(F.lit(1.0), F.least(bh, rh))
        gap = r["x1"] - b["x2"]
        level = F.abs((b["y1"] + bh / 2) - (r["y1"] + rh / 2)) <= 0.38 * most
        return (b["role"] == r["role"]) & (ratio <= 1.45) & level & (gap >= -0.4 * most) & (gap <= F.greatest(F.lit(10.0), F.least(F.lit(72.0), 2.2 * most))) & (ratio <= 1.35)

    return _merged(lines, ["y1", "x1", "pos"], fits, last)


def row_clusters(elements: DataFrame, tolerance: float) -> DataFrame:
    """(page_id, pos, row_no): from the top, an element joins the first row whose middle centre is within tolerance, else it opens one."""
    pages = ordered(elements.withColumn("cy", (F.col("y1") + F.col("y2")) / 2), ["y1", "pos"], ["cy"])

    def middle(xs: Column) -> Column:
        s, n = F.sort_array(xs), F.size(xs)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    def step(acc: Column, r: Column) -> Column:
        rows = F.coalesce(acc["rows"], F.array().cast("array<array<double>>"))
        n = F.size(rows)
        near = F.filter(F.sequence(F.lit(0), n), lambda k: F.coalesce(F.abs(middle(F.get(rows, k)) - r["cy"]) <= tolerance, F.lit(False)))
        own = F.array(r["cy"])

        def joined(at: Column) -> Column:
            grown = F.when(at.isNull(), F.concat(rows, F.array(own))).otherwise(F.transform(rows, lambda x, k: F.when(k == at, F.concat(x, own)).otherwise(x)))
            return F.struct(grown.alias("rows"), F.concat(F.coalesce(acc["of"], F.array().cast("array<int>")), F.array(F.coalesce(at, n))).alias("of"))

        return let(F.get(near, F.lit(0)), joined)

    return _assigned(pages, "rows array<array<double>>, of array<int>", step, "row_no")


def winners(elements: DataFrame, key: str) -> DataFrame:
    """(page_id, key, pos): of rows with one key the most confident, the first of equals."""
    return elements.groupBy("page_id", key).agg(F.min_by("pos", F.struct(-F.col("confidence"), "pos")).alias("pos"))


def layered(elements: DataFrame) -> DataFrame:
    """(page_id, pos, z): texts are raised above whatever they overlap."""
    p = R.pairs(elements.where("type = 'text'"), elements.where("type <> 'text'"), G.intersects(G.box("a_"), G.box("b_")))
    top = p.groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.max("b_z_index").alias("top"))
    return elements.join(top, ["page_id", "pos"], "left").select("page_id", "pos", F.greatest(F.col("z_index"), F.coalesce(F.col("top") + 1, F.col("z_index"))).alias("z"))


def grouped_by_gap(elements: DataFrame, gap: float) -> DataFrame:
    """(page_id, pos, grp): boxes joined over gaps of so many pixels; grp is the least position of the group."""
    pages = ordered(elements, ["pos"], ["x1", "y1", "x2", "y2"])

    def near(a: Column, b: Column) -> Column:
        return F.greatest(a["x1"] - b["x2"], b["x1"] - a["x2"], a["y1"] - b["y2"], b["y1"] - a["y2"], F.lit(0.0)) <= gap

    def step(acc: Column, i: Column) -> Column:
        me = F.get(F.col("rows"), i)
        found = F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), i), lambda j: near(F.get(F.col("rows"), j), me)), lambda j: F.get(acc, j)))
        both = F.struct(found.alias("all"), F.array_min(found).alias("least"))
        return let(both, lambda f: F.transform(acc, lambda x: F.when(F.array_contains(f["all"], x), f["least"]).otherwise(x)))

    labels = F.aggregate(F.sequence(F.lit(0), F.size("rows") - 1), F.transform("rows", lambda r: r["pos"]), step)
    return pages.select("page_id", F.explode(F.arrays_zip(F.col("rows"), labels.alias("l"))).alias("x")).select("page_id", F.col("x.rows.pos").alias("pos"), F.col("x.l").alias("grp"))

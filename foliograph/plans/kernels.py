"""Queries over the pixels of tiles and of what was drawn in their place: losses, repairs, audits, surfaces.

A tile c has v, the source, and w, what was drawn. Greys of the tiles lie around 127, so 150 and more stands for white
and 110 and less for ink; a tile's text stands in every fifth diagonal. Shares are the rules' own; counts are theirs
over a thousand, as a tile has 64 pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import raster as P
from ..sources.views import PIXELS, pixels
from .raster import CTE, both
from .registry import add

KEY = ["page_id", "px", "py"]
TEXT, BORDER = "(page_id + px + py) % 5 = 0", "(px IN (0, 7) OR py IN (0, 7))"
LOST = "v < 118 AND w >= 128"


def pair(name: str, run, sql: str, more: str = "") -> None:
    """A query over tiles and what was drawn."""
    add(name, lambda spark, sf_dir: run(both(spark, sf_dir)), f"{CTE}{more} {sql}")


def tile(name: str, run, sql: str, more: str = "") -> None:
    add(name, lambda spark, sf_dir: run(pixels(spark, sf_dir)), f"WITH {PIXELS}{more} {sql}")


def n(condition: str) -> Column:
    return F.expr(f"count_if({condition})")


def mean(value: str, condition: str) -> Column:
    return F.expr(f"round(avg(CASE WHEN {condition} THEN {value} END), 6)")


def means(value: str, condition: str) -> str:
    return f"round(avg(CASE WHEN {condition} THEN {value} END), 6)"


def labelled(mask: str, source: str) -> str:
    """Components of masked pixels of a table as lab (page_id, px, py, label), by recursion."""
    return f""", mk AS (SELECT page_id, px, py FROM {source} WHERE {mask}), cc AS (SELECT page_id, px AS rx, py AS ry, px, py FROM mk UNION SELECT c2.page_id, c2.rx, c2.ry, m.px, m.py FROM cc c2 JOIN mk m ON m.page_id = c2.page_id AND abs(m.px - c2.px) <= 1 AND abs(m.py - c2.py) <= 1),
    lab AS (SELECT page_id, px, py, min(ry * 1000000 + rx) AS label FROM cc GROUP BY page_id, px, py)"""


RCTE, RPIX = CTE.replace("WITH", "WITH RECURSIVE", 1), f"WITH RECURSIVE {PIXELS}"

pair(
    "ras21_outside_change",
    lambda c: c.groupBy("page_id").agg((n("v >= 150") / F.count("*")).alias("white_before"), (n("w >= 150") / F.count("*")).alias("white_after"), (n("abs(v - w) > 16 AND NOT (px BETWEEN 2 AND 5 AND py BETWEEN 2 AND 5)") / n("NOT (px BETWEEN 2 AND 5 AND py BETWEEN 2 AND 5)")).alias("outside")),
    "SELECT page_id, CAST(count_if(v >= 150) AS DOUBLE) / count(*) AS white_before, CAST(count_if(w >= 150) AS DOUBLE) / count(*) AS white_after, CAST(count_if(abs(v - w) > 16 AND NOT (px BETWEEN 2 AND 5 AND py BETWEEN 2 AND 5)) AS DOUBLE) / count_if(NOT (px BETWEEN 2 AND 5 AND py BETWEEN 2 AND 5)) AS outside FROM c GROUP BY page_id",
)


def losses(c: DataFrame) -> DataFrame:
    """Pixels newly erased, less those of glyphs, and the largest piece of them."""
    part = P.components(c, F.expr(f"{LOST} AND NOT {TEXT}")).groupBy("page_id", "label").agg(F.count("*").alias("n"))
    return c.select("page_id").distinct().join(part.groupBy("page_id").agg(F.sum("n").alias("lost"), F.max("n").alias("largest")), "page_id", "left").na.fill(0)


add("ras22_new_loss", lambda s, d: losses(both(s, d)), f"{RCTE}{labelled(f'{LOST} AND NOT {TEXT}', 'c')}, k AS (SELECT page_id, label, count(*) AS n FROM lab GROUP BY page_id, label), p AS (SELECT DISTINCT page_id FROM c) SELECT page_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS lost, coalesce(max(n), 0) AS largest FROM p LEFT JOIN k USING (page_id) GROUP BY page_id")
_QUARTER = "CAST(floor(px / 4.0) + 2 * floor(py / 4.0) AS INT)"
pair(
    "ras24_region_error",
    lambda c: c.where(f"NOT {TEXT}").withColumn("region", F.expr(_QUARTER)).groupBy("page_id", "region").agg(F.expr("round(avg(abs(v - 127)), 6)").alias("before"), F.expr("round(avg(abs(v - w)), 6)").alias("after"), n(LOST).alias("lost")),
    f"SELECT page_id, {_QUARTER} AS region, round(avg(abs(v - 127)), 6) AS before, round(avg(abs(v - w)), 6) AS after, count_if({LOST}) AS lost FROM c WHERE NOT {TEXT} GROUP BY ALL",
)
_AUDIT = {
    "salient": "abs(v - 127) >= 12", "missing": f"abs(v - 127) >= 12 AND {LOST}", "mismatch": "abs(v - 127) >= 12 AND abs(v - w) >= 24", "pale_gap": "v BETWEEN 135 AND 149 AND w >= 150", "text_pale_gap": f"{TEXT} AND v BETWEEN 135 AND 149 AND w >= 150",
    "washed": "v < 115 AND w BETWEEN 115 AND 135", "surface": f"{BORDER} AND abs(v - w) >= 20", "ghosts": f"{TEXT} AND v < 118 AND w < 118", "erased_text": f"{TEXT} AND v < 118 AND w >= 118", "baked": f"NOT {TEXT} AND v = w", "darker": "w < v - 16", "lighter": "w > v + 16", "kept": "abs(v - w) <= 8", "white": "w >= 150", "ink": "w <= 110",
}
pair("ras25_audit", lambda c: c.groupBy("page_id").agg(*(n(s).alias(k) for k, s in _AUDIT.items())), "SELECT page_id, " + ", ".join(f"count_if({s}) AS {k}" for k, s in _AUDIT.items()) + " FROM c GROUP BY page_id")


def repaired(c: DataFrame) -> DataFrame:
    """What stands in for a lost piece: a flat shape where its source is of one grey, else a cut of the source; single pixels are left."""
    part = P.components(c, F.expr(LOST)).join(c.select(*KEY, "v"), KEY).groupBy("page_id", "label").agg(F.count("*").alias("n"), F.min("px").alias("x1"), F.max("px").alias("x2"), F.min("py").alias("y1"), F.max("py").alias("y2"), (F.max("v") - F.min("v")).alias("spread"))
    return part.where("n >= 2").select("page_id", "label", "x1", "y1", "x2", "y2", F.when(F.col("spread") <= 8, "flat").otherwise("cutout").alias("repair"))


add("ras26_region_repair", lambda s, d: repaired(both(s, d)), f"{RCTE}{labelled(LOST, 'c')} SELECT page_id, label, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2, CASE WHEN max(v) - min(v) <= 8 THEN 'flat' ELSE 'cutout' END AS repair FROM lab JOIN c USING (page_id, px, py) GROUP BY page_id, label HAVING count(*) >= 2")
_RECOVERED = "CASE WHEN v BETWEEN 128 AND 149 AND w >= 150 THEN v ELSE w END"
pair(
    "ras29_recovery",
    lambda c: c.withColumn("r", F.expr(_RECOVERED)).groupBy("page_id").agg(F.sum(F.abs(F.col("v") - F.col("w"))).alias("before"), F.sum(F.abs(F.col("v") - F.col("r"))).alias("after")).select("page_id", "before", "after", (F.col("after") < F.col("before")).alias("taken")),
    f"SELECT page_id, CAST(sum(abs(v - w)) AS BIGINT) AS before, CAST(sum(abs(v - {_RECOVERED})) AS BIGINT) AS after, sum(abs(v - {_RECOVERED})) < sum(abs(v - w)) AS taken FROM c GROUP BY page_id",
)


def residuals(p: DataFrame) -> DataFrame:
    """Pieces that stand off the ground, with their boxes, and how much of all such pixels pieces of two and more hold."""
    part = P.components(p, F.expr("v < 112")).groupBy("page_id", "label").agg(F.count("*").alias("n"), F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2"))
    total = part.groupBy("page_id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("held"))
    return part.where("n >= 2").join(total, "page_id").select("page_id", "label", "n", "x1", "y1", "x2", "y2", F.round(F.col("held") / F.col("all"), 6).alias("coverage"))


add("ras31_residual_extraction", lambda s, d: residuals(pixels(s, d)), f"{RPIX}{labelled('v < 112', 'px')}, k AS (SELECT page_id, label, count(*) AS n, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2 FROM lab GROUP BY page_id, label), t AS (SELECT page_id, sum(n) AS a, sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS h FROM k GROUP BY page_id) SELECT page_id, label, n, x1, y1, x2, y2, round(h / a, 6) AS coverage FROM k JOIN t USING (page_id) WHERE n >= 2")


def islands(p: DataFrame, mask: str) -> DataFrame:
    part = P.components(p, F.expr(mask)).groupBy("page_id", "label").agg(F.count("*").alias("n"), F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2"))
    return part.withColumn("fill", F.col("n") / ((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)))


_ISLANDS = "k AS (SELECT page_id, label, count(*) AS n, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2, CAST(count(*) AS DOUBLE) / ((max(px) - min(px) + 1) * (max(py) - min(py) + 1)) AS fill FROM lab GROUP BY page_id, label)"
add(
    "ras32_sparse_partition",
    lambda s, d: islands(pixels(s, d), "v >= 134").groupBy("page_id").agg(F.max("n").alias("most"), F.count_if(F.col("n") >= 2).alias("islands"), F.min_by("fill", F.struct(-F.col("n"), "label")).alias("fill")).select("page_id", "islands", ((F.col("most") >= 0.15 * 64) & (F.col("fill") < 0.45) & F.col("islands").between(2, 12)).alias("split")),
    f"{RPIX}{labelled('v >= 134', 'px')}, {_ISLANDS} SELECT page_id, count_if(n >= 2) AS islands, max(n) >= 9.6 AND arg_min(fill, struct_pack(a := -n, b := label)) < 0.45 AND count_if(n >= 2) BETWEEN 2 AND 12 AS split FROM k GROUP BY page_id",
)
add(
    "ras33_monolithic_split",
    lambda s, d: islands(pixels(s, d), "v <> 127").groupBy("page_id").agg(F.sum("n").alias("all"), F.max((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)).alias("box"), F.count_if(F.col("n") >= 2).alias("pieces"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("held")).select("page_id", "pieces", ((F.col("box") >= 0.8 * 64) & (F.col("pieces") >= 2) & (F.col("held") >= 0.95 * F.col("all"))).alias("split")),
    f"{RPIX}{labelled('v <> 127', 'px')}, {_ISLANDS} SELECT page_id, count_if(n >= 2) AS pieces, max((x2 - x1 + 1) * (y2 - y1 + 1)) >= 51.2 AND count_if(n >= 2) >= 2 AND sum(CASE WHEN n >= 2 THEN n ELSE 0 END) >= 0.95 * sum(n) AS split FROM k GROUP BY page_id",
)
add(
    "ras41_image_dominant",
    lambda s, d: islands(pixels(s, d), "v >= 120").join(pixels(s, d).groupBy("page_id").agg(n("v < 90").alias("holes")), "page_id").groupBy("page_id").agg(F.max(F.struct("n", "fill", ((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)).alias("box"))).alias("m"), F.max("holes").alias("holes")).select("page_id", (F.col("m.n") / 64).alias("share"), ((F.col("m.n") >= 0.35 * 64) & (F.col("m.box") >= 0.7 * 64) & (F.col("m.fill") >= 0.5) & (F.col("holes") <= 0.035 * 64)).alias("dominant")),
    f"{RPIX}{labelled('v >= 120', 'px')}, {_ISLANDS}, h AS (SELECT page_id, count_if(v < 90) AS holes FROM px GROUP BY page_id), m AS (SELECT page_id, max(struct_pack(n := n, fill := fill, box := (x2 - x1 + 1) * (y2 - y1 + 1))) AS m FROM k GROUP BY page_id) SELECT page_id, m.n / 64 AS share, m.n >= 22.4 AND m.box >= 44.8 AND m.fill >= 0.5 AND holes <= 2.24 AS dominant FROM m JOIN h USING (page_id)",
)
pair(
    "ras34_text_shadow",
    lambda c: c.where("v BETWEEN 112 AND 122").groupBy("page_id").agg(n(TEXT).alias("under"), F.count("*").alias("n"), F.avg("v").alias("m")).select("page_id", (((F.col("under") >= 0.25 * F.col("n")) & (F.col("m") > 117)) | (F.col("n") <= 4)).alias("shadow")),
    f"SELECT page_id, (count_if({TEXT}) >= 0.25 * count(*) AND avg(v) > 117) OR count(*) <= 4 AS shadow FROM c WHERE v BETWEEN 112 AND 122 GROUP BY page_id",
)
pair(
    "ras35_shape_support",
    lambda c: c.groupBy("page_id").agg((n("px BETWEEN 1 AND 6 AND py BETWEEN 1 AND 6 AND abs(v - w) <= 12") / 36).alias("colour"), (n(f"{BORDER} AND abs(v - w) >= 16") / 28).alias("rim")).select("page_id", "colour", "rim", ((F.col("colour") >= 0.35) | (F.col("rim") >= 0.30)).alias("supported")),
    f"SELECT page_id, count_if(px BETWEEN 1 AND 6 AND py BETWEEN 1 AND 6 AND abs(v - w) <= 12) / 36 AS colour, count_if({BORDER} AND abs(v - w) >= 16) / 28 AS rim, count_if(px BETWEEN 1 AND 6 AND py BETWEEN 1 AND 6 AND abs(v - w) <= 12) / 36 >= 0.35 OR count_if({BORDER} AND abs(v - w) >= 16) / 28 >= 0.30 AS supported FROM c GROUP BY page_id",
)
_OWNER = f"CASE WHEN {TEXT} AND v < 120 THEN 'glyph' WHEN v >= 150 OR v <= 104 THEN 'colour' WHEN {BORDER} THEN 'stroke' WHEN abs(v - w) <= 6 THEN 'image' ELSE 'free' END"
pair("ras36_occupancy", lambda c: c.withColumn("owner", F.expr(_OWNER)).groupBy("page_id", "owner").agg(F.count("*").alias("n")), f"SELECT page_id, {_OWNER} AS owner, count(*) AS n FROM c GROUP BY ALL")


def asset_cut(p: DataFrame) -> DataFrame:
    """A module's crop: the pixels of its texts are cleaned to the crop's median and owned by text, the ground is clear, the others are the asset's."""
    ground = p.where("px BETWEEN 1 AND 6 AND py BETWEEN 1 AND 6").withColumn("text", F.expr(TEXT))
    middle = ground.where("NOT text").groupBy("page_id").agg(F.floor(F.median("v")).cast("int").alias("m"))
    return ground.join(middle, "page_id").select(*KEY, F.when(F.col("text"), F.col("m")).otherwise(F.col("v")).alias("v"), F.when(F.abs(F.when(F.col("text"), F.col("m")).otherwise(F.col("v")) - F.col("m")) < 6, 0).otherwise(255).alias("alpha"), F.when(F.col("text"), "text").otherwise("asset").alias("owner"))


tile("ras37_asset_cut", asset_cut, f"SELECT page_id, px, py, CASE WHEN t THEN m ELSE v END AS v, CASE WHEN abs(CASE WHEN t THEN m ELSE v END - m) < 6 THEN 0 ELSE 255 END AS alpha, CASE WHEN t THEN 'text' ELSE 'asset' END AS owner FROM g JOIN md USING (page_id)", f", g AS (SELECT page_id, px, py, v, {TEXT} AS t FROM px WHERE px BETWEEN 1 AND 6 AND py BETWEEN 1 AND 6), md AS (SELECT page_id, CAST(floor(median(v)) AS INT) AS m FROM g WHERE NOT t GROUP BY page_id)")
pair(
    "ras42_restored_text",
    lambda c: c.withColumn("r", F.expr(f"CASE WHEN {TEXT} AND page_id % 3 = 0 THEN v ELSE w END")).groupBy("page_id").agg(F.sum("r").alias("total"), n("r <> w").alias("restored")),
    f"SELECT page_id, CAST(sum(CASE WHEN {TEXT} AND page_id % 3 = 0 THEN v ELSE w END) AS BIGINT) AS total, count_if({TEXT} AND page_id % 3 = 0 AND v <> w) AS restored FROM c GROUP BY page_id",
)
_IDX = "page_id, px, py"


_ROUNDS = ", i0 AS (SELECT page_id, px, py, CASE WHEN NOT ({mask}) THEN CAST(v AS DOUBLE) END AS x FROM px)" + "".join(f", i{k} AS (SELECT a.page_id, a.px, a.py, coalesce(any_value(a.x), round(avg(b.x), 9)) AS x FROM i{k - 1} a LEFT JOIN i{k - 1} b ON a.page_id = b.page_id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 AND b.x IS NOT NULL GROUP BY a.page_id, a.px, a.py)" for k in (1, 2, 3))
_HOLE = "px BETWEEN 2 AND 5 AND py BETWEEN 2 AND 5"
tile("ras12_inpaint", lambda p: P.inpainted(p, _HOLE).select(*KEY, F.round("x", 4).alias("x")), f"SELECT {_IDX}, round(x, 4) AS x FROM i3", _ROUNDS.format(mask=_HOLE))
tile("ras54_inpainting", lambda p: P.inpainted(p, TEXT).join(p, KEY).groupBy("page_id").agg(F.round(F.avg(F.abs(F.col("x") - F.col("v"))), 3).alias("error"), F.count_if(F.col("x").isNull()).alias("pending")), "SELECT page_id, round(avg(abs(x - v)), 3) AS error, count_if(x IS NULL) AS pending FROM i3 JOIN px USING (page_id, px, py) GROUP BY page_id", _ROUNDS.format(mask=TEXT))


def filled(p: DataFrame) -> DataFrame:
    """A tile without its text: flat grounds take the border's median, others the row's own median; what is then still dark is counted."""
    border = p.where(BORDER).groupBy("page_id").agg(F.floor(F.median("v")).alias("b"), (F.max("v") - F.min("v")).alias("spread"))
    row = p.where(f"NOT {TEXT}").groupBy("page_id", "py").agg(F.floor(F.median("v")).alias("r"))
    f = p.join(border, "page_id").join(row, ["page_id", "py"]).withColumn("f", F.when(F.expr(TEXT), F.when(F.col("spread") <= 45, F.col("b")).otherwise(F.col("r"))).otherwise(F.col("v")))
    return f.groupBy("page_id").agg(F.sum("f").cast("long").alias("total"), F.count_if(F.expr(TEXT) & (F.col("f") < 118)).alias("again"))


tile("ras14_background_clean", filled, f"SELECT page_id, CAST(sum(f) AS BIGINT) AS total, count_if({TEXT} AND f < 118) AS again FROM fl GROUP BY page_id", f", bd AS (SELECT page_id, floor(median(v)) AS b, max(v) - min(v) AS spread FROM px WHERE {BORDER} GROUP BY page_id), rw AS (SELECT page_id, py, floor(median(v)) AS r FROM px WHERE NOT {TEXT} GROUP BY page_id, py), fl AS (SELECT page_id, px, py, CASE WHEN {TEXT} THEN CASE WHEN spread <= 45 THEN b ELSE r END ELSE v END AS f FROM px JOIN bd USING (page_id) JOIN rw USING (page_id, py))")
pair(
    "ras19_erased_text",
    lambda c: c.join(c.where(f"NOT {TEXT}").groupBy("page_id").agg(F.floor(F.median("v")).alias("m")), "page_id").withColumn("x", F.when(F.expr(f"{TEXT} AND v < 122"), F.col("m")).otherwise(F.col("v"))).groupBy("page_id").agg(F.sum("x").cast("long").alias("total"), n(f"{TEXT} AND v < 122").alias("erased"), n(f"{TEXT} AND v < 122 AND px < 4").alias("in_asset")),
    f", md AS (SELECT page_id, floor(median(v)) AS m FROM c WHERE NOT {TEXT} GROUP BY page_id) SELECT page_id, CAST(sum(CASE WHEN {TEXT} AND v < 122 THEN m ELSE v END) AS BIGINT) AS total, count_if({TEXT} AND v < 122) AS erased, count_if({TEXT} AND v < 122 AND px < 4) AS in_asset FROM c JOIN md USING (page_id) GROUP BY page_id",
)
tile(
    "ras50_flat_surface",
    lambda p: p.join(p.where(BORDER).groupBy("page_id").agg(F.median("v").alias("b")), "page_id").groupBy("page_id").agg((n(f"{BORDER} AND abs(v - b) <= 25") / 28).alias("rim"), (n("abs(v - b) <= 25") / 64).alias("page"), F.max(150 - F.col("b")).alias("off")).select("page_id", "rim", "page", ((F.col("off") >= 12) & (F.col("rim") >= 0.9) & (F.col("page") >= 0.85)).alias("flat")),
    f"SELECT page_id, count_if({BORDER} AND abs(v - b) <= 25) / 28 AS rim, count_if(abs(v - b) <= 25) / 64 AS page, max(150 - b) >= 12 AND count_if({BORDER} AND abs(v - b) <= 25) / 28 >= 0.9 AND count_if(abs(v - b) <= 25) / 64 >= 0.85 AS flat FROM px JOIN bb USING (page_id) GROUP BY page_id",
    f", bb AS (SELECT page_id, median(v) AS b FROM px WHERE {BORDER} GROUP BY page_id)",
)
tile(
    "ras55_title_weight",
    lambda p: p.groupBy("page_id", "py").agg(n("v < 118").alias("ink"), F.expr("max(CASE WHEN v < 118 THEN px END) - min(CASE WHEN v < 118 THEN px END) + 1").alias("reach")).groupBy("page_id").agg((F.sum("ink") / 64).alias("share"), F.count_if(F.col("ink") >= 4).alias("strokes"), F.max("reach").alias("widest")).select("page_id", "share", "strokes", (F.col("share").between(0.10, 0.60) & (F.col("strokes") >= 1) & (F.col("widest") <= 1.6 * 8)).alias("bold")),
    "SELECT page_id, sum(ink) / 64 AS share, count_if(ink >= 4) AS strokes, coalesce(sum(ink) / 64 BETWEEN 0.10 AND 0.60 AND count_if(ink >= 4) >= 1 AND max(reach) <= 12.8, false) AS bold FROM rk GROUP BY page_id",
    ", rk AS (SELECT page_id, py, count_if(v < 118) AS ink, max(CASE WHEN v < 118 THEN px END) - min(CASE WHEN v < 118 THEN px END) + 1 AS reach FROM px GROUP BY page_id, py)",
)
tile(
    "ras56_colour_sample",
    lambda p: p.where(f"px BETWEEN 1 AND 6 AND py BETWEEN 1 AND 6 AND NOT {TEXT}").groupBy("page_id").agg(F.median("v").alias("ground")).join(p, "page_id").groupBy("page_id").agg(F.max("ground").alias("ground"), mean("v", "px BETWEEN 2 AND 6 AND py BETWEEN 2 AND 6").alias("centre"), F.max_by("v", F.struct(F.abs(F.col("v") - F.col("ground")), "v")).alias("foreground")),
    f"SELECT page_id, max(ground) AS ground, {means('v', 'px BETWEEN 2 AND 6 AND py BETWEEN 2 AND 6')} AS centre, arg_max(v, struct_pack(a := abs(v - ground), b := v)) AS foreground FROM px JOIN gr USING (page_id) GROUP BY page_id",
    f", gr AS (SELECT page_id, median(v) AS ground FROM px WHERE px BETWEEN 1 AND 6 AND py BETWEEN 1 AND 6 AND NOT {TEXT} GROUP BY page_id)",
)
_UNION = f"({TEXT} OR v < 112 OR {BORDER})"
pair(
    "ras57_still_original",
    lambda c: c.where(_UNION).groupBy("page_id").agg(F.round(F.avg(F.abs(F.col("v") - F.col("w"))), 6).alias("off"), F.round(F.stddev_pop("v"), 6).alias("spread"), (F.count("*") / 64).alias("occupied")).select("page_id", "off", "spread", "occupied", ((F.col("off") < 35) & (F.col("spread") > 10)).alias("original")),
    f"SELECT page_id, round(avg(abs(v - w)), 6) AS off, round(stddev_pop(v), 6) AS spread, count(*) / 64 AS occupied, round(avg(abs(v - w)), 6) < 35 AND round(stddev_pop(v), 6) > 10 AS original FROM c WHERE {_UNION} GROUP BY page_id",
)
tile(
    "ras47_complex_badge",
    lambda p: p.where("(px - 3.5) * (px - 3.5) + (py - 3.5) * (py - 3.5) <= 16").groupBy("page_id").agg((n("v >= 150") / F.count("*")).alias("white"), F.round(F.var_pop("v"), 4).alias("variance"), n("abs(v - 127) >= 20").alias("strong")).select("page_id", "white", "variance", ((F.col("variance") >= 150) & (F.col("white") < 0.35) & (F.col("strong") >= 5)).alias("complex")),
    "SELECT page_id, count_if(v >= 150) / count(*) AS white, round(var_pop(v), 4) AS variance, round(var_pop(v), 4) >= 150 AND count_if(v >= 150) / count(*) < 0.35 AND count_if(abs(v - 127) >= 20) >= 5 AS complex FROM px WHERE (px - 3.5) * (px - 3.5) + (py - 3.5) * (py - 3.5) <= 16 GROUP BY page_id",
)
pair(
    "ras45_colour_damage",
    lambda c: c.groupBy("page_id").agg(n("v BETWEEN 118 AND 140 AND w < 108").alias("damaged"), n(LOST).alias("hidden")).select("page_id", "damaged", (F.col("damaged") >= 2).alias("replaced"), F.when(F.col("hidden") >= 3, F.col("page_id") % 26 + 1).otherwise(F.col("page_id") % 26).alias("z")),
    f"SELECT page_id, count_if(v BETWEEN 118 AND 140 AND w < 108) AS damaged, count_if(v BETWEEN 118 AND 140 AND w < 108) >= 2 AS replaced, CASE WHEN count_if({LOST}) >= 3 THEN page_id % 26 + 1 ELSE page_id % 26 END AS z FROM c GROUP BY page_id",
)
pair(
    "ras53_reclean",
    lambda c: c.where(TEXT).groupBy("page_id").agg((n("abs(w - 127) >= 22") / F.count("*")).alias("edge"), ((F.max("w") - F.min("w")) / 255).alias("contrast")).select("page_id", "edge", ((F.col("edge") > 0.075) & (F.col("contrast") > 0.08)).alias("again")),
    f"SELECT page_id, count_if(abs(w - 127) >= 22) / count(*) AS edge, count_if(abs(w - 127) >= 22) / count(*) > 0.075 AND (max(w) - min(w)) / 255 > 0.08 AS again FROM c WHERE {TEXT} GROUP BY page_id",
)

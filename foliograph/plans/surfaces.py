"""Queries of images, contours, layers and the larger pixel rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import images
from ..operators import raster as P
from ..sources.views import ELEMENTS, PIXELS, RICH, elements, pixels, rich, table
from .geometry import H, W
from .kernels import BORDER, KEY, RPIX, TEXT, labelled, n, pair
from .loops import _EDGES, edges
from .registry import add, query


# sources of images
@query(
    "src02_image_normalise",
    f"""WITH {PIXELS}, o AS (SELECT DISTINCT page_id, page_id % 8 + 1 AS turn FROM px), k AS (SELECT page_id, CASE WHEN turn IN (1, 4, 5, 8) AND turn NOT IN (4, 8) OR turn = 4 OR turn = 5 THEN 0 ELSE 7 END AS x0, turn FROM o)
    SELECT o.page_id, 8 AS width, 8 AS height, CAST(3 * sum(v) AS BIGINT) AS total, CAST(max(CASE WHEN px = CASE turn WHEN 1 THEN 0 WHEN 2 THEN 7 WHEN 3 THEN 7 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 7 ELSE 7 END
      AND py = CASE turn WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 7 WHEN 4 THEN 7 WHEN 5 THEN 0 WHEN 6 THEN 7 WHEN 7 THEN 7 ELSE 0 END THEN v END) AS INT) AS corner FROM o JOIN px ON o.page_id = px.page_id GROUP BY o.page_id""",
)
def image_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written as PNG files' bytes, then read, turned upright, made RGB and written again."""

    def written(tile: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((8, 8), np.uint8)
        grid[tile["py"], tile["px"]] = tile["v"]
        return pd.DataFrame({"page_id": [tile["page_id"].iloc[0]], "content": [images.to_png(grid)], "orientation": [int(tile["page_id"].iloc[0] % 8 + 1)]})

    stored = pixels(spark, sf_dir).groupBy("page_id").applyInPandas(written, "page_id bigint, content binary, orientation int")

    def measured(batches):
        for rows in batches:
            seen = [images.from_png(bytes(x)) for x in rows["png"]]
            rows = rows[["page_id", "width", "height"]].copy()
            rows["total"], rows["corner"] = [int(x.sum(dtype=np.int64)) for x in seen], [int(x[0, 0, 0]) for x in seen]
            yield rows

    return images.normalised(stored).mapInPandas(measured, "page_id bigint, width int, height int, total bigint, corner int")


_BOXES = "k AS (SELECT page_id, label, count(*) AS n, min(px) AS x1, min(py) AS y1, max(px) + 1 AS x2, max(py) + 1 AS y2 FROM lab GROUP BY page_id, label)"


def boxes(p: DataFrame, mask: Column) -> DataFrame:
    return P.components(p, mask).groupBy("page_id", "label").agg(F.count("*").alias("n"), F.min("px").alias("x1"), F.min("py").alias("y1"), (F.max("px") + 1).alias("x2"), (F.max("py") + 1).alias("y2"))


def top(df: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy(F.desc("area"), "label")
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def contours(p: DataFrame) -> DataFrame:
    """Outer boxes of edges, the forty largest of a page, if they are large enough; wide, tall or plain; confidence 0.45."""
    b = boxes(edges(p), F.lit(True)).withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    ratio = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    kept = top(b, 40).where((F.col("area") >= 0.015 * 64) & (F.col("x2") - F.col("x1") >= 2) & (F.col("y2") - F.col("y1") >= 2))
    return kept.select("page_id", "label", "area", F.when(ratio > 2.8, "wide").when(ratio < 0.35, "tall").otherwise("region").alias("kind"), F.lit(0.45).alias("confidence"))


_EPIX = f"{RPIX}, {_EDGES}{labelled('true', 'ed')}, {_BOXES}, a AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM k)"
add(
    "src05_contours",
    lambda s, d: contours(pixels(s, d)),
    f"{_EPIX}, t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, label) AS nth FROM a) SELECT page_id, label, area, CASE WHEN (x2 - x1) / (y2 - y1) > 2.8 THEN 'wide' WHEN (x2 - x1) / (y2 - y1) < 0.35 THEN 'tall' ELSE 'region' END AS kind, 0.45 AS confidence FROM t WHERE nth <= 40 AND area >= 0.96 AND x2 - x1 >= 2 AND y2 - y1 >= 2",
)


def segments(p: DataFrame) -> DataFrame:
    """Edges grown by a pixel, in pieces: the thirty largest of a page that don't span nearly all of it, with their mask's share of the box."""
    near = F.explode(F.expr("flatten(transform(sequence(px - 1, px + 1), a -> transform(sequence(py - 1, py + 1), b -> struct(a AS px, b AS py))))"))
    grown = edges(p).select("page_id", near.alias("t")).select("page_id", "t.px", "t.py").distinct().join(p.select(*KEY), KEY)
    b = boxes(grown, F.lit(True)).withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return top(b, 30).where((F.col("area") >= 0.64) & (F.col("area") <= 0.92 * 64)).select("page_id", "label", "area", F.round(F.col("n") / F.col("area"), 6).alias("fill"))


add(
    "src06_segments",
    lambda s, d: segments(pixels(s, d)),
    f"{RPIX}, {_EDGES}, dl AS (SELECT DISTINCT p.page_id, p.px, p.py FROM px p JOIN ed ON p.page_id = ed.page_id AND abs(p.px - ed.px) <= 1 AND abs(p.py - ed.py) <= 1){labelled('true', 'dl')}, {_BOXES}, t AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY page_id ORDER BY (x2 - x1) * (y2 - y1) DESC, label) AS nth FROM k) SELECT page_id, label, area, round(n / area, 6) AS fill FROM t WHERE nth <= 30 AND area BETWEEN 0.64 AND 58.88",
)
_REPLY = """CASE event_id % 4 WHEN 0 THEN 'Here: {"elements":[{"id":"e' || user_id || '"}]}' WHEN 1 THEN '{`elements`:[{`id`:`q' || user_id || '`}]}' WHEN 2 THEN 'no json at all' ELSE '{"elements":[]} thanks' END"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer: the JSON inside it, once mended if it can't be read, then checked for its elements."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_REPLY).alias("raw"))
    inner = S.outer_json(F.col("raw"))
    mended = F.regexp_replace(inner, "`", '"')
    told = e.select("event_id", F.get_json_object(inner, "$.elements").alias("plain"), F.get_json_object(mended, "$.elements").alias("again"))
    items = F.from_json(F.coalesce("plain", "again"), "array<struct<id:string>>")
    return told.select("event_id", F.when(F.col("plain").isNotNull(), "read").when(F.col("again").isNotNull(), "mended").otherwise("failed").alias("state"), F.get(items["id"], F.lit(0)).alias("first"))


add(
    "src07_vision_replies",
    replies,
    f"""WITH r AS (SELECT event_id, regexp_extract({_REPLY}, '\\{{[\\s\\S]*\\}}') AS raw FROM events), t AS (SELECT event_id, CASE WHEN json_valid(raw) THEN 'read' WHEN json_valid(replace(raw, '`', '"')) THEN 'mended' ELSE 'failed' END AS state, replace(raw, '`', '"') AS j FROM r)
    SELECT event_id, state, CASE WHEN state <> 'failed' THEN json_extract_string(j, '$.elements[0].id') END AS first FROM t""",
)

# layers: a page's elements over each other in cells of 40 pixels
_CELL = f"c AS (SELECT x.page_id, cx, cy, z_index, pos, CAST(element_id % 256 AS DOUBLE) AS ink, confidence * 0.9::DOUBLE AS alpha FROM x, (SELECT unnest(range(0, {W // 40})) AS cx), (SELECT unnest(range(0, {H // 40})) AS cy) WHERE cx * 40 + 20 BETWEEN x1 AND x2 AND cy * 40 + 20 BETWEEN y1 AND y2"


def layered(x: DataFrame) -> DataFrame:
    """Source over ground by draw order, from a white page."""
    at = lambda lo, hi: F.sequence(F.ceil((F.col(lo) - 20) / 40).cast("int"), F.floor((F.col(hi) - 20) / 40).cast("int"))
    fits = (F.ceil((F.col("x1") - 20) / 40) <= F.floor((F.col("x2") - 20) / 40)) & (F.ceil((F.col("y1") - 20) / 40) <= F.floor((F.col("y2") - 20) / 40))
    cells = x.where(fits).withColumn("cx", F.explode(at("x1", "x2"))).withColumn("cy", F.explode(at("y1", "y2"))).where(F.col("cx").between(0, W // 40 - 1) & F.col("cy").between(0, H // 40 - 1))
    stack = cells.groupBy("page_id", "cx", "cy").agg(F.sort_array(F.collect_list(F.struct("z_index", "pos", (F.col("element_id") % 256).cast("double").alias("ink"), (F.col("confidence") * 0.9).alias("alpha")))).alias("s"))
    over = F.aggregate("s", F.lit(255.0), lambda ground, e: e["ink"] * e["alpha"] + ground * (1 - e["alpha"]))
    return stack.select("page_id", "cx", "cy", F.size("s").cast("long").alias("layers"), F.round(over + 1e-7, 3).alias("value"))


_OVER = "SELECT page_id, cx, cy, count(*) AS layers, round(sum(ink * alpha * above) + 255 * exp(sum(ln(1 - alpha))) + 1e-7, 3) AS value FROM (SELECT *, exp(coalesce(sum(ln(1 - alpha)) OVER (PARTITION BY page_id, cx, cy ORDER BY z_index, pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS above FROM c) GROUP BY page_id, cx, cy"
add("ras20_composite", lambda s, d: layered(rich(s, d)), f"WITH {ELEMENTS}, {RICH}, {_CELL}) {_OVER}")
add("snk03_preview", lambda s, d: layered(rich(s, d).where("NOT suppressed AND strategy <> 'ignore'")), f"WITH {ELEMENTS}, {RICH}, {_CELL} AND NOT suppressed AND strategy <> 'ignore') {_OVER}")

# pieces of pixels and what they are
_OPEN = "op AS (SELECT a.page_id, a.px, a.py FROM mk0 a JOIN mk0 b ON a.page_id = b.page_id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 GROUP BY a.page_id, a.px, a.py HAVING count(*) = 9), dl AS (SELECT DISTINCT p.page_id, p.px, p.py FROM px p JOIN op ON p.page_id = op.page_id AND abs(p.px - op.px) <= 1 AND abs(p.py - op.py) <= 1)"


def opened(p: DataFrame, mask: str) -> DataFrame:
    """The mask without what is thinner than three pixels: shrunk by one, then grown by one."""
    m = p.where(mask).select(*KEY)
    near = F.explode(F.expr("flatten(transform(sequence(px - 1, px + 1), a -> transform(sequence(py - 1, py + 1), b -> struct(a AS px, b AS py))))"))
    inner = m.select("page_id", near.alias("t")).groupBy("page_id", F.col("t.px").alias("px"), F.col("t.py").alias("py")).agg(F.count("*").alias("n")).where("n = 9")
    back = inner.select("page_id", near.alias("t")).select("page_id", "t.px", "t.py").distinct()
    return p.select(*KEY).join(back, KEY)


add("ras28_text_support", lambda s, d: boxes(opened(pixels(s, d), "v BETWEEN 112 AND 148"), F.lit(True)).where("n >= 9").select("page_id", "label", "n"), f"{RPIX}, mk0 AS (SELECT page_id, px, py FROM px WHERE v BETWEEN 112 AND 148), {_OPEN}{labelled('true', 'dl')}, {_BOXES} SELECT page_id, label, n FROM k WHERE n >= 9")
_FILL, _KIND = "CAST(n AS DOUBLE) / ((x2 - x1) * (y2 - y1))", "CASE WHEN (x2 - x1) * (y2 - y1) >= 32 THEN 'panel' WHEN n >= 4 AND abs((x2 - x1) - (y2 - y1)) <= 1 AND {f} BETWEEN 0.6 AND 0.9 THEN 'round' WHEN n >= 4 AND {f} > 0.9 THEN 'flat' WHEN n >= 3 THEN 'detail' ELSE 'residual' END"
add("ras30_white_objects", lambda s, d: boxes(pixels(s, d), F.expr("v >= 136")).selectExpr("page_id", "label", _KIND.format(f=_FILL) + " AS kind", "n"), f"{RPIX}{labelled('v >= 136', 'px')}, {_BOXES} SELECT page_id, label, {_KIND.format(f=_FILL)} AS kind, n FROM k")
add(
    "ras39_leading_icon",
    lambda s, d: pixels(s, d).where("v < 118").groupBy("page_id", "px").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.sort_array(F.collect_list("px")).alias("cols")).select("page_id", F.coalesce(F.array_min(F.filter(F.transform("cols", lambda c, i: F.when((F.get("cols", i + 1) > c + 1) | (i == F.size("cols") - 1), c)), lambda c: c.isNotNull())), F.lit(-1)).alias("ends"), F.array_min("cols").alias("starts")).select("page_id", "starts", "ends", (F.col("ends") - F.col("starts") <= 2).alias("icon")),
    f"WITH {PIXELS}, q AS (SELECT DISTINCT page_id, px FROM px WHERE v < 118), l AS (SELECT *, lead(px) OVER (PARTITION BY page_id ORDER BY px) AS nx FROM q) SELECT page_id, min(px) AS starts, min(CASE WHEN nx IS NULL OR nx > px + 1 THEN px END) AS ends, min(CASE WHEN nx IS NULL OR nx > px + 1 THEN px END) - min(px) <= 2 AS icon FROM l GROUP BY page_id",
)
add(
    "ras40_object_checks",
    lambda s, d: boxes(pixels(s, d), F.expr("v < 116")).where("n >= 2").selectExpr("page_id", "label", f"round({_FILL}, 6) AS fill", f"CASE WHEN n = (x2 - x1) * (y2 - y1) AND n >= 4 THEN 'square' WHEN abs((x2 - x1) - (y2 - y1)) <= 1 AND {_FILL} BETWEEN 0.42 AND 0.86 THEN 'round' WHEN x2 - x1 >= 4 AND {_FILL} < 0.42 THEN 'missing_plate' ELSE 'fine' END AS verdict"),
    f"{RPIX}{labelled('v < 116', 'px')}, {_BOXES} SELECT page_id, label, round({_FILL}, 6) AS fill, CASE WHEN n = (x2 - x1) * (y2 - y1) AND n >= 4 THEN 'square' WHEN abs((x2 - x1) - (y2 - y1)) <= 1 AND {_FILL} BETWEEN 0.42 AND 0.86 THEN 'round' WHEN x2 - x1 >= 4 AND {_FILL} < 0.42 THEN 'missing_plate' ELSE 'fine' END AS verdict FROM k WHERE n >= 2",
)


def separated(p: DataFrame) -> DataFrame:
    """Owned pieces taken out of the ground: small ones by the mean of the ground around each pixel, large ones by the median of the tile's ring."""
    part = P.components(p, F.expr("v >= 140"))
    sizes = part.groupBy("page_id", "label").agg(F.count("*").alias("n"))
    owned = part.join(sizes, ["page_id", "label"]).select(*KEY, "n")
    ring = p.where(f"{BORDER} AND v < 140").groupBy("page_id").agg(F.median("v").alias("ring"))
    near = p.where("v < 140").select("page_id", "v", F.explode(F.expr("flatten(transform(sequence(px - 1, px + 1), a -> transform(sequence(py - 1, py + 1), b -> struct(a AS px, b AS py))))")).alias("t"))
    around = near.groupBy("page_id", F.col("t.px").alias("px"), F.col("t.py").alias("py")).agg(F.avg("v").alias("m"))
    return owned.join(ring, "page_id", "left").join(around, KEY, "left").select(*KEY, F.round(F.when(F.col("n") <= 3, F.coalesce("m", "ring")).otherwise(F.col("ring")), 6).alias("ground"))


add("ras43_foreground", lambda s, d: separated(pixels(s, d)), f"{RPIX}{labelled('v >= 140', 'px')}, z AS (SELECT page_id, label, count(*) AS n FROM lab GROUP BY page_id, label), rg AS (SELECT page_id, median(v) AS ring FROM px WHERE {BORDER} AND v < 140 GROUP BY page_id), ar AS (SELECT l.page_id, l.px, l.py, avg(p.v) AS m FROM lab l JOIN px p ON p.page_id = l.page_id AND abs(p.px - l.px) <= 1 AND abs(p.py - l.py) <= 1 AND p.v < 140 GROUP BY l.page_id, l.px, l.py) SELECT page_id, px, py, round(CASE WHEN n <= 3 THEN coalesce(m, ring) ELSE ring END, 6) AS ground FROM lab JOIN z USING (page_id, label) LEFT JOIN rg USING (page_id) LEFT JOIN ar USING (page_id, px, py)")
_QUARTER = "CAST(floor(px / 4.0) + 2 * floor(py / 4.0) AS INT)"
pair(
    "ras44_background_objects",
    lambda c: c.withColumn("region", F.expr(_QUARTER)).groupBy("page_id", "region").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias("off"), n("v < 118").alias("ink")).where("ink >= 2").groupBy("page_id").agg(F.count("*").alias("boxes"), F.max("off").alias("worst")).select("page_id", "boxes", (F.col("worst") < 40).alias("taken"), F.when(F.col("worst") < 40, F.col("boxes")).otherwise(0).alias("staged")),
    f", q AS (SELECT page_id, {_QUARTER} AS region, avg(abs(v - w)) AS off, count_if(v < 118) AS ink FROM c GROUP BY ALL) SELECT page_id, count(*) AS boxes, max(off) < 40 AS taken, CASE WHEN max(off) < 40 THEN count(*) ELSE 0 END AS staged FROM q WHERE ink >= 2 GROUP BY page_id",
)
pair(
    "ras46_region_difference",
    lambda c: c.withColumn("region", F.expr(_QUARTER)).groupBy("page_id", "region").agg(F.round(F.avg(F.abs(F.col("v") - F.col("w"))), 6).alias("pixels"), F.abs(n("abs(v - 127) >= 18") - n("abs(w - 127) >= 18")).alias("edges")).withColumn("issue", (F.col("pixels") >= 20) | (F.col("edges") >= 4)),
    f"SELECT page_id, {_QUARTER} AS region, round(avg(abs(v - w)), 6) AS pixels, abs(count_if(abs(v - 127) >= 18) - count_if(abs(w - 127) >= 18)) AS edges, round(avg(abs(v - w)), 6) >= 20 OR abs(count_if(abs(v - 127) >= 18) - count_if(abs(w - 127) >= 18)) >= 4 AS issue FROM c GROUP BY ALL",
)


def trimmed(p: DataFrame) -> DataFrame:
    """A container's box from its row and column profiles: rows and columns that are hardly filled stand out of it and go; corners tell a card."""
    rows = p.groupBy("page_id", "py").agg((n("v >= 120") / 8).alias("f")).where("f >= 0.5").groupBy("page_id").agg(F.min("py").alias("y1"), F.max("py").alias("y2"))
    cols = p.groupBy("page_id", "px").agg((n("v >= 120") / 8).alias("f")).where("f >= 0.5").groupBy("page_id").agg(F.min("px").alias("x1"), F.max("px").alias("x2"))
    corners = p.groupBy("page_id").agg(n("px IN (0, 7) AND py IN (0, 7) AND v >= 120").alias("corners"), n(f"{BORDER} AND v >= 120").alias("ring"))
    return rows.join(cols, "page_id").join(corners, "page_id").select("page_id", "x1", "y1", "x2", "y2", F.when(F.col("corners") >= 3, "card").when(F.col("ring") >= 20, "rounded").otherwise("none").alias("shape"))


add("ras52_container_shape", lambda s, d: trimmed(pixels(s, d)), f"WITH {PIXELS}, r AS (SELECT page_id, min(py) AS y1, max(py) AS y2 FROM (SELECT page_id, py FROM px GROUP BY page_id, py HAVING count_if(v >= 120) >= 4) GROUP BY page_id), cl AS (SELECT page_id, min(px) AS x1, max(px) AS x2 FROM (SELECT page_id, px FROM px GROUP BY page_id, px HAVING count_if(v >= 120) >= 4) GROUP BY page_id), k AS (SELECT page_id, count_if(px IN (0, 7) AND py IN (0, 7) AND v >= 120) AS corners, count_if({BORDER} AND v >= 120) AS ring FROM px GROUP BY page_id) SELECT page_id, x1, y1, x2, y2, CASE WHEN corners >= 3 THEN 'card' WHEN ring >= 20 THEN 'rounded' ELSE 'none' END AS shape FROM r JOIN cl USING (page_id) JOIN k USING (page_id)")
add(
    "ras58_detail_ring",
    lambda s, d: P.dilated(pixels(s, d), F.expr("150 - v >= 38")).join(pixels(s, d), KEY).groupBy("page_id").agg(F.count("*").alias("detail"), n("150 - v >= 38").alias("seed"), F.round(F.avg(F.expr("CASE WHEN NOT (150 - v >= 38) THEN v END")), 6).alias("ring"), n(f"{TEXT} AND 150 - v >= 38").alias("cleared")),
    f"WITH {PIXELS}, d AS (SELECT DISTINCT p.page_id, p.px, p.py, p.v FROM px p JOIN px q ON p.page_id = q.page_id AND abs(p.px - q.px) <= 1 AND abs(p.py - q.py) <= 1 AND 150 - q.v >= 38) SELECT page_id, count(*) AS detail, count_if(150 - v >= 38) AS seed, round(avg(CASE WHEN NOT (150 - v >= 38) THEN v END), 6) AS ring, count_if({TEXT} AND 150 - v >= 38) AS cleared FROM d GROUP BY page_id",
)


def duplicates(p: DataFrame) -> DataFrame:
    """Tiles that cover the next one: the lower one's pixels there become clear if the colours agree."""
    a = p.where("v >= 116").select("page_id", "px", "py", "v")
    b = a.select((F.col("page_id") - 1).alias("page_id"), "px", "py", F.col("v").alias("u"))
    sizes = lambda t, name: t.groupBy("page_id").agg(F.count("*").alias(name))
    both_ = a.join(b, KEY).groupBy("page_id").agg(F.count("*").alias("common"), F.round(F.avg(F.abs(F.col("v") - F.col("u"))), 6).alias("error"))
    over = F.col("common") / F.least("na", "nb")
    return both_.join(sizes(a, "na"), "page_id").join(sizes(b, "nb"), "page_id").select("page_id", F.round(over, 6).alias("overlap"), "error", F.when((over >= 0.94) & (F.col("error") <= 26), F.col("common")).otherwise(0).alias("cleared"))


add("ras38_duplicate_contour", lambda s, d: duplicates(pixels(s, d)), f"WITH {PIXELS}, a AS (SELECT * FROM px WHERE v >= 116), z AS (SELECT page_id, count(*) AS n FROM a GROUP BY page_id), j AS (SELECT a.page_id, count(*) AS common, round(avg(abs(a.v - b.v)), 6) AS error FROM a JOIN a b ON b.page_id = a.page_id + 1 AND a.px = b.px AND a.py = b.py GROUP BY a.page_id) SELECT j.page_id, round(common / least(x.n, y.n), 6) AS overlap, error, CASE WHEN common / least(x.n, y.n) >= 0.94 AND error <= 26 THEN common ELSE 0 END AS cleared FROM j JOIN z x ON x.page_id = j.page_id JOIN z y ON y.page_id = j.page_id + 1")

# counters and records of a page's way through the stages
_COUNTERS = {"texts": "type = 'text'", "shown_texts": "type = 'text' AND visible", "images": "type = 'image'", "shapes": "type IN ('rectangle', 'ellipse')", "lines": "type = 'line'", "suppressed": "suppressed", "owned": "owned_by IS NOT NULL", "grouped": "group_id IS NOT NULL", "sure": "confidence >= 0.85", "unsure": "confidence < 0.5", "badges": "role = 'badge'", "titles": "role IN ('title', 'card_title')", "complex": "complexity >= 0.6", "whole": "whole", "background": "strategy = 'background'", "outside": f"x2 > {W} OR y2 > {H}"}
add("agg14_stage_rollup", lambda s, d: rich(s, d).groupBy("page_id").agg(*(n(c).alias(k) for k, c in _COUNTERS.items())), f"WITH {ELEMENTS}, {RICH} SELECT page_id, " + ", ".join(f"count_if({c}) AS {k}" for k, c in _COUNTERS.items()) + " FROM x GROUP BY page_id")
_ATTEMPT = {"way": "string_split('planner,detector,vision,local', ',')[CAST(pos % 4 + 1 AS INT)]", "fine": "confidence >= 0.4"}
add(
    "sta12_routing_record",
    lambda s, d: elements(s, d).where("pos < 4").select("page_id", "pos", F.element_at(F.split(F.lit("planner,detector,vision,local"), ","), (F.col("pos") % 4 + 1).cast("int")).alias("way"), (F.col("confidence") >= 0.4).alias("fine")).groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("way", F.when(F.col("fine"), "+").otherwise("-")).alias("t")))), lambda x: x["t"]), ">").alias("attempts"), F.count_if(~F.col("fine")).alias("fallbacks"), F.min_by("way", F.when(F.col("fine"), F.col("pos"))).alias("used"), F.min_by("way", "pos").alias("requested")),
    f"WITH {ELEMENTS}, a AS (SELECT page_id, pos, {_ATTEMPT['way']} AS way, {_ATTEMPT['fine']} AS fine FROM e WHERE pos < 4) SELECT page_id, string_agg(way || CASE WHEN fine THEN '+' ELSE '-' END, '>' ORDER BY pos) AS attempts, count_if(NOT fine) AS fallbacks, arg_min(way, CASE WHEN fine THEN pos END) AS used, arg_min(way, pos) AS requested FROM a GROUP BY page_id",
)
add("prj14_settings_view", lambda s, d: table(s, d, "events").select("event_id", S.mask_key(F.md5(F.col("event_id").cast("string"))).alias("key"), F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("default")).alias("model"), (F.col("user_id") % 3 > 0).alias("configured"), F.when(F.col("user_id") % 4 == 0, "proxy").otherwise("direct").alias("way")), "SELECT event_id, left(md5(CAST(event_id AS VARCHAR)), 5) || repeat('*', 24) || right(md5(CAST(event_id AS VARCHAR)), 3) AS key, CASE WHEN event_type <> 'view' THEN event_type ELSE 'default' END AS model, user_id % 3 > 0 AS configured, CASE WHEN user_id % 4 = 0 THEN 'proxy' ELSE 'direct' END AS way FROM events")

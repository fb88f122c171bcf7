"""Queries of filters, projections, aggregates, sequences, sorts and versions of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import relations as R
from ..operators import scores as C
from ..operators import sequence as Q
from ..sources.views import ELEMENTS, OCR_LINES, RICH, elements, ocr_lines, rich
from .geometry import AREA_A, AREA_B, CX, CY, EDGES, H, INTER, W
from .registry import add, query
from .relations import EDITED, IMAGES, RECTS, TEXTS, A, B, edited, q
from .scalars import case

BOX = list(EDGES)


def simple(name: str, run, sql: str, cte: str = ELEMENTS) -> None:
    add(name, lambda spark, sf_dir: run(elements(spark, sf_dir)), f"WITH {cte} {sql}")


# filters
simple("fil01_visible", lambda e: e.where("visible").select("page_id", "pos"), "SELECT page_id, pos FROM e WHERE visible")
simple("fil02_membership", lambda e: e.where(F.col("type").isin("image", "ellipse")).select("page_id", "pos", "type"), "SELECT page_id, pos, type FROM e WHERE type IN ('image', 'ellipse')")
simple(
    "fil04_editable_in_asset",
    lambda e: R.covered(e.where(TEXTS + " AND visible AND confidence >= 0.5"), e.where(IMAGES), 0.85, "left_anti").select("page_id", "pos"),
    """SELECT page_id, pos FROM e t WHERE type = 'text' AND visible AND confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.page_id = t.page_id AND b.pos <> t.pos AND b.type = 'image'
    AND greatest(least(t.x2, b.x2) - greatest(t.x1, b.x1), 0) * greatest(least(t.y2, b.y2) - greatest(t.y1, b.y1), 0) / greatest((t.x2 - t.x1) * (t.y2 - t.y1), 1.0) >= 0.85)""",
)


def top(order: list, n: int, key: str = "page_id"):
    return F.row_number().over(Window.partitionBy(key).orderBy(*order)) <= n


def ranked(e: DataFrame, where: str, order: list, n: int) -> DataFrame:
    return e.where(where).withColumn("__top", top(order, n)).where("__top").select("page_id", "pos")


def ranked_sql(where: str, order: str, n: int) -> str:
    return f"SELECT page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS rn FROM e WHERE {where}) WHERE rn <= {n}"


simple("fil09_uncertain_visual", lambda e: e.where("type <> 'text' AND (confidence < 0.5 OR (confidence < 0.75 AND type = 'image'))").select("page_id", "pos"), "SELECT page_id, pos FROM e WHERE type <> 'text' AND (confidence < 0.5 OR (confidence < 0.75 AND type = 'image'))")


@query("fil15_page_gate", f"WITH {ELEMENTS}, p AS (SELECT page_id, avg(confidence) >= 0.49 AS approved FROM e GROUP BY page_id), l AS (SELECT *, lag(approved) OVER (ORDER BY page_id) AS before FROM p) SELECT page_id, approved, page_id = 0 OR coalesce(before, false) AS open FROM l")
def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is open if the page before it is approved."""
    p = elements(spark, sf_dir).groupBy("page_id").agg((F.avg("confidence") >= 0.49).alias("approved"))
    before = p.select((F.col("page_id") + 1).alias("page_id"), F.col("approved").alias("before"))
    return p.join(before, "page_id", "left").select("page_id", "approved", ((F.col("page_id") == 0) | F.coalesce("before", F.lit(False))).alias("open"))



# projections
add("prj01_text_element", lambda s, d: ocr_lines(s, d).select("page_id", F.format_string("text_%03d", F.col("pos") + 1).alias("id"), F.greatest(F.lit(4.0), F.col("x2") - F.col("x1")).alias("w"), F.greatest(F.lit(4.0), F.col("y2") - F.col("y1")).alias("h"), F.lit(20).alias("z")), f"WITH {OCR_LINES} SELECT page_id, printf('text_%03d', pos + 1) AS id, greatest(4.0, x2 - x1) AS w, greatest(4.0, y2 - y1) AS h, 20 AS z FROM o")
simple("prj02_classify", lambda e: e.select("page_id", "pos", F.when(F.col("type") == "image", F.when(G.is_page_environment(G.box(), W, H), "background").otherwise("picture")).when(F.col("type") == "text", "text").otherwise("shape").alias("scene")), f"SELECT page_id, pos, CASE WHEN type = 'image' THEN CASE WHEN width * height / {W * H}.0 >= 0.75 OR (width >= {0.88 * W!r} AND height >= {0.7 * H!r}) THEN 'background' ELSE 'picture' END WHEN type = 'text' THEN 'text' ELSE 'shape' END AS scene FROM e")
simple("prj03_layer", lambda e: e.select("page_id", "pos", F.when(F.col("group_id") == "g0", F.least(S.lookup(F.col("type"), S.LAYER_OF_TYPE), F.lit(5))).otherwise(S.lookup(F.col("type"), S.LAYER_OF_TYPE)).alias("z")), f"SELECT page_id, pos, CASE WHEN group_id = 'g0' THEN least({case('type', S.LAYER_OF_TYPE)}, 5) ELSE {case('type', S.LAYER_OF_TYPE)} END AS z FROM e")
_ROUTE = "CASE WHEN suppressed THEN 'group' WHEN owned_by IS NOT NULL THEN 'owned' WHEN type = 'text' AND confidence >= 0.5 THEN 'editable_text' WHEN type IN ('rectangle', 'ellipse') AND confidence >= 0.6 THEN 'native_shape' WHEN type = 'line' THEN 'native_line' WHEN confidence < 0.3 THEN 'transparent_image' ELSE 'local_image' END"
simple("prj04_router", lambda e: e.select("page_id", "pos", F.when(F.col("suppressed"), "group").when(F.col("owned_by").isNotNull(), "owned").when((F.col("type") == "text") & (F.col("confidence") >= 0.5), "editable_text").when(F.col("type").isin("rectangle", "ellipse") & (F.col("confidence") >= 0.6), "native_shape").when(F.col("type") == "line", "native_line").when(F.col("confidence") < 0.3, "transparent_image").otherwise("local_image").alias("strategy")), f"SELECT page_id, pos, {_ROUTE} AS strategy FROM e")
simple("prj05_default_strategy", lambda e: e.select("page_id", "pos", S.lookup(F.col("type"), S.STRATEGY_OF_TYPE, F.lit("local_image")).alias("strategy")), f"SELECT page_id, pos, {case('type', S.STRATEGY_OF_TYPE, chr(39) + 'local_image' + chr(39))} AS strategy FROM e")
_ALIAS = {"text": "editable_text", "image": "cutout_image", "rectangle": "mixed_component"}
simple("prj06_strategy_alias", lambda e: e.select("page_id", "pos", S.lookup(F.col("type"), _ALIAS, F.col("type")).alias("strategy")), f"SELECT page_id, pos, {case('type', _ALIAS, 'type')} AS strategy FROM e")
simple("prj07_scene_element", lambda e: e.select("page_id", "pos", F.to_json(F.struct(F.col("x1").cast("int").alias("left"), F.col("y1").cast("int").alias("top"))).alias("bbox"), (F.col("type") != "image").alias("editable"), F.when(F.col("pos") % 6 == 0, F.lit(0.7)).otherwise(F.col("confidence")).alias("confidence")), """SELECT page_id, pos, '{"left":' || CAST(CAST(x1 AS INT) AS VARCHAR) || ',"top":' || CAST(CAST(y1 AS INT) AS VARCHAR) || '}' AS bbox, type <> 'image' AS editable, CASE WHEN pos % 6 = 0 THEN 0.7 ELSE confidence END AS confidence FROM e""")
simple("prj08_textbox", lambda e: e.where(TEXTS).select("page_id", "pos", F.greatest(F.lit(0.0), F.col("x1") - 0.03 * F.col("width")).alias("x1"), F.least(F.lit(float(W)), F.col("x2") + 0.03 * F.col("width")).alias("x2")), f"SELECT page_id, pos, greatest(0.0, x1 - 0.03 * width) AS x1, least({W}.0, x2 + 0.03 * width) AS x2 FROM e WHERE type = 'text'")
simple("prj09_refined_box", lambda e: e.where(TEXTS).select("page_id", "pos", G.bounded_move(F.col("x1"), F.col("x1") + F.col("width") / 2 - 40, F.lit(0.03 * W), F.lit(0.0), W - F.col("width")).alias("x"), F.least(F.col("width") * 1.15, F.lit(80.0)).alias("w")), f"SELECT page_id, pos, least(greatest(greatest(x1 - {0.03 * W!r}, least(x1 + {0.03 * W!r}, x1 + width / 2 - 40)), 0.0), {W} - width) AS x, least(width * 1.15, 80.0) AS w FROM e WHERE type = 'text'")
simple("prj10_refined_size", lambda e: e.where(TEXTS).select("page_id", "pos", (F.col("height") * (0.62 + 0.38 * F.least(F.greatest(F.least(F.col("width") / 100, F.col("height") / 40), F.lit(0.85)), F.lit(1.15)))).alias("size")), "SELECT page_id, pos, height * (0.62 + CAST(0.38 AS DOUBLE) * least(greatest(least(width / 100, height / 40), 0.85), 1.15)) AS size FROM e WHERE type = 'text'")
simple("prj12_region_weight", lambda e: e.select("page_id", "pos", S.lookup(F.col("type"), S.REGION_WEIGHTS, F.lit(1.0)).alias("w")), f"SELECT page_id, pos, {case('type', S.REGION_WEIGHTS, '1.0')} AS w FROM e")

# aggregates
simple("agg01_alignment", lambda e: C.buckets(e, {"top": F.bround(F.col("y1") / 12, 0)}), "SELECT page_id, round_even(y1 / 12, 0) AS top, count(*) AS n, array_to_string(list(pos ORDER BY pos), ',') AS members FROM e GROUP BY page_id, top HAVING count(*) >= 2")
simple("agg02_repetition", lambda e: C.buckets(e, {"type": F.col("type"), "w": F.bround(F.col("width") / 8, 0), "ratio": F.bround(10 * F.col("width") / F.col("height"), 0)}), "SELECT page_id, type, round_even(width / 8, 0) AS w, round_even(10 * width / height, 0) AS ratio, count(*) AS n, array_to_string(list(pos ORDER BY pos), ',') AS members FROM e GROUP BY page_id, type, w, ratio HAVING count(*) >= 2")
simple("agg03_grid", lambda e: C.buckets(e.where("visible"), {}), "SELECT page_id, count(*) AS n, array_to_string(list(pos ORDER BY pos), ',') AS members FROM e WHERE visible GROUP BY page_id HAVING count(*) >= 2")
simple("agg04_groups", lambda e: e.where("group_id IS NOT NULL").groupBy("page_id", "group_id").agg(F.min_by("type", "pos").alias("role"), F.count("*").alias("n")), "SELECT page_id, group_id, arg_min(type, pos) AS role, count(*) AS n FROM e WHERE group_id IS NOT NULL GROUP BY page_id, group_id")
simple("agg05_text_coverage", lambda e: e.where(TEXTS).groupBy("page_id").agg(F.count_distinct("text").alias("found"), F.count_distinct(F.when(F.col("visible"), F.col("text"))).alias("kept")).withColumn("ratio", F.col("kept") / F.col("found")), "SELECT page_id, count(DISTINCT text) AS found, count(DISTINCT CASE WHEN visible THEN text END) AS kept, count(DISTINCT CASE WHEN visible THEN text END) / count(DISTINCT text) AS ratio FROM e WHERE type = 'text' GROUP BY page_id")
simple("agg08_critical", lambda e: e.groupBy("page_id").agg(C.weighted_mean(F.floor(F.col("confidence") * 100).cast("double"), S.lookup(F.col("type"), S.REGION_WEIGHTS, F.lit(1.0))).alias("score")), f"SELECT page_id, sum(floor(confidence * 100) * {case('type', S.REGION_WEIGHTS, '1.0')}) / greatest(1.0, sum({case('type', S.REGION_WEIGHTS, '1.0')})) AS score FROM e GROUP BY page_id")
simple("agg11_badge_penalty", lambda e: e.groupBy("page_id").agg(C.capped(F.count_if(F.col("visible") & (F.col("type") == "ellipse") & F.col("group_id").isNotNull()), 0.05, 0.25).alias("penalty")), "SELECT page_id, least(count_if(visible AND type = 'ellipse' AND group_id IS NOT NULL) * 0.05, 0.25) AS penalty FROM e GROUP BY page_id")
simple("agg13_layout_counters", lambda e: e.agg(F.count_if(F.col("suppressed")).alias("suppressed"), F.count_if(F.col("owned_by").isNotNull()).alias("owned"), F.count_if(F.col("group_id").isNotNull()).alias("grouped"), F.count_if(F.col("confidence") < 0.5).alias("unsure"), F.count_if(F.col("visible")).alias("visible")), "SELECT count_if(suppressed) AS suppressed, count_if(owned_by IS NOT NULL) AS owned, count_if(group_id IS NOT NULL) AS grouped, count_if(confidence < 0.5) AS unsure, count_if(visible) AS visible FROM e")
simple("agg15_statistics", lambda e: e.groupBy("page_id").agg(F.median("width").alias("mid"), F.percentile("height", 0.85).alias("p85")), "SELECT page_id, median(width) AS mid, quantile_cont(height, 0.85) AS p85 FROM e GROUP BY page_id")
simple("agg18_majority", lambda e: C.mode_first(e, ["page_id"], "group_id"), "SELECT page_id, group_id, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, group_id) AS rn FROM (SELECT page_id, group_id, count(*) AS n FROM e WHERE group_id IS NOT NULL GROUP BY page_id, group_id)) WHERE rn = 1")
add("agg19_text_occupancy", lambda s, d: R.pairs(elements(s, d).where(RECTS), elements(s, d).where(TEXTS), G.intersects(A(), B())).groupBy("page_id", F.col("a_pos").alias("pos")).agg((F.sum(G.intersection(A(), B())) / F.max(G.area(A()))).alias("share")), q(f"{INTER} > 0", RECTS, TEXTS) + f" SELECT page_id, a_pos AS pos, sum({INTER}) / max({AREA_A}) AS share FROM q GROUP BY page_id, a_pos")
add("agg20_foreign_groups", lambda s, d: R.pairs(elements(s, d).where(RECTS), elements(s, d), G.center_inside(B(), A()) & F.col("b_group_id").isNotNull() & ~F.col("b_group_id").eqNullSafe(F.col("a_group_id"))).groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.count_distinct("b_group_id").alias("groups")), q(f"{CX['b']} BETWEEN a_x1 AND a_x2 AND {CY['b']} BETWEEN a_y1 AND a_y2 AND b_group_id IS NOT NULL AND b_group_id IS DISTINCT FROM a_group_id", RECTS) + " SELECT page_id, a_pos AS pos, count(DISTINCT b_group_id) AS groups FROM q GROUP BY page_id, a_pos")
simple("agg21_issue_counts", lambda e: e.groupBy("page_id").agg(F.count_if((F.col("x2") > W) | (F.col("y2") > H)).alias("outside"), F.bool_or(F.col("suppressed") & (F.col("type") == "text")).alias("lost_text")), f"SELECT page_id, count_if(x2 > {W} OR y2 > {H}) AS outside, bool_or(suppressed AND type = 'text') AS lost_text FROM e GROUP BY page_id")
add("agg22_module_extent", lambda s, d: R.pairs(elements(s, d).where(RECTS), elements(s, d), on=(G.coverage(B(), A()) >= 0.35) & (F.col("a_pos") != F.col("b_pos")), how="left").groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.coalesce(F.max("b_z_index") + 1, F.lit(0)).alias("top"), F.coalesce(F.min("b_z_index") - 1, F.lit(0)).alias("bottom")), q(f"a_pos <> b_pos AND {INTER} / greatest({AREA_B}, 1.0) >= 0.35", RECTS) + ", m AS (SELECT page_id, a_pos, max(b_z_index) + 1 AS top, min(b_z_index) - 1 AS bottom FROM q GROUP BY page_id, a_pos) SELECT e.page_id, e.pos, coalesce(top, 0) AS top, coalesce(bottom, 0) AS bottom FROM e LEFT JOIN m ON e.page_id = m.page_id AND e.pos = m.a_pos WHERE type = 'rectangle'")


# sequences


@query("win03_paragraphs", f"WITH {OCR_LINES}, l AS (SELECT *, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y1) OVER w AS py, lag(y2) OVER w AS pz FROM o WINDOW w AS (PARTITION BY page_id ORDER BY pos)), n AS (SELECT *, CASE WHEN py IS NULL OR y1 - pz > greatest(6.0, 0.75 * (pz - py)) OR least(x2, px2) - greatest(x1, px1) <= -2 * (pz - py) THEN 1 ELSE 0 END AS new FROM l) SELECT page_id, pos, CAST(sum(new) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS block FROM n")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ocr_lines(spark, sf_dir)

    def breaks(p):
        high = p["y2"] - p["y1"]
        return (F.col("y1") - p["y2"] > F.greatest(F.lit(6.0), 0.75 * high)) | (F.least("x2", p["x2"]) - F.greatest("x1", p["x1"]) <= -2 * high)

    return Q.islands(o, breaks).select("page_id", "pos", "block")






simple("win07_draw_order", lambda e: e.where("visible").select("page_id", "pos", F.row_number().over(Window.partitionBy("page_id").orderBy("z_index", "pos")).alias("nth")), "SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY z_index, pos) AS INT) AS nth FROM e WHERE visible")
_BOX_OF = ", ".join(f"{c} := {c}" for c in EDGES)


def greedy_sql(order: str, least: str, frm: str = "e", more: str = "", most: int | None = None) -> str:
    """A recursion over a page's rows in order that carries the boxes taken so far."""
    common = "greatest(least(r.x2, b.x2) - greatest(r.x1, b.x1), 0) * greatest(least(r.y2, b.y2) - greatest(r.y1, b.y1), 0) / greatest(least((r.x2 - r.x1) * (r.y2 - r.y1), (b.x2 - b.x1) * (b.y2 - b.y1)), 1.0)"
    return f"""WITH RECURSIVE {ELEMENTS}{more}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS i FROM {frm}),
    g AS (SELECT page_id, i, pos, [struct_pack({_BOX_OF})] AS kept, true AS ok FROM r WHERE i = 1
      UNION ALL SELECT page_id, i, pos, CASE WHEN ok THEN list_append(kept, me) ELSE kept END, ok FROM (
        SELECT r.page_id, r.i, r.pos, g.kept, struct_pack(x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2) AS me, len([b FOR b IN g.kept IF {common} >= {least}]) = 0{f" AND len(g.kept) < {most}" if most else ""} AS ok FROM g JOIN r ON g.page_id = r.page_id AND r.i = g.i + 1))
    SELECT page_id, pos FROM g WHERE ok"""


add("win09_greedy_selection", lambda s, d: Q.select_greedily(elements(s, d), ["pos"], lambda a, b: Q.overlap_of(a, b) >= 0.05, BOX), greedy_sql("pos", "0.05"))
#: Image owners of a page at most; a box that covers so much of a wide title's text is none.
OWNERS, TITLE_SHARE, TITLE_WIDTH = 40, 0.55, 240.0
_TITLED = f""", {RICH}, t AS (SELECT page_id, x1, y1, x2, y2 FROM x WHERE type = 'text' AND role = 'title' AND width >= {TITLE_WIDTH / 2}),
    o AS (SELECT * FROM e WHERE type <> 'text' AND NOT EXISTS (SELECT 1 FROM t WHERE t.page_id = e.page_id AND greatest(least(t.x2, e.x2) - greatest(t.x1, e.x1), 0) * greatest(least(t.y2, e.y2) - greatest(t.y1, e.y1), 0) / greatest((t.x2 - t.x1) * (t.y2 - t.y1), 1.0) >= {TITLE_SHARE}))"""


def planned_owners(elements: DataFrame, titles: DataFrame, most: int = OWNERS) -> DataFrame:
    """(page_id, pos): boxes that become image owners, in order: none that covers a title, none that meets one before it, so many at most."""
    return Q.select_greedily(R.covering(elements, titles, TITLE_SHARE, "left_anti"), ["pos"], lambda a, b: Q.overlap_of(a, b) >= 0.05, BOX, most)


# titles of these pages are half as wide as those of slides
add("win09_planned_owners", lambda s, d: planned_owners(elements(s, d).where("type <> 'text'"), rich(s, d).where(f"type = 'text' AND role = 'title' AND width >= {TITLE_WIDTH / 2}"), 9), greedy_sql("pos", "0.05", "o", _TITLED, 9))
add("win10_container_selection", lambda s, d: Q.select_greedily(elements(s, d).withColumn("size", -F.col("width") * F.col("height")), ["size", "pos"], lambda a, b: Q.overlap_of(a, b) >= 0.75, BOX), greedy_sql("-(width * height), pos", "0.75"))
add("set09_candidate_dedup", lambda s, d: Q.select_greedily(elements(s, d).withColumn("sure", -F.col("confidence")), ["sure", "pos"], lambda a, b: Q.overlap_of(a, b) >= 0.85, BOX), greedy_sql("-confidence, pos", "0.85"))

# sorts
simple("srt02_largest", lambda e: ranked(e, "true", [F.desc(F.col("width") * F.col("height")), "pos"], 12), ranked_sql("true", "width * height DESC, pos", 12))
simple("srt03_scan_order", lambda e: ranked(e, "visible", ["y1", "x1", "width", "height", "pos"], 24), ranked_sql("visible", "y1, x1, width, height, pos", 24))
simple("srt04_first_best", lambda e: e.groupBy("page_id").agg(F.min_by("pos", F.struct(-F.col("confidence"), "pos")).alias("best"), F.min_by("pos", F.struct("confidence", "pos")).alias("worst")), "SELECT page_id, arg_min(pos, struct_pack(a := -confidence, b := pos)) AS best, arg_min(pos, struct_pack(a := confidence, b := pos)) AS worst FROM e GROUP BY page_id")
simple("srt05_page_names", lambda e: e.select("page_id").distinct().select("page_id", F.row_number().over(Window.partitionBy(F.floor(F.col("page_id") / 100)).orderBy(F.regexp_extract(F.concat(F.lit("page_"), F.col("page_id").cast("string")), "(\\d+)$", 1).cast("int"))).alias("nth")), "SELECT page_id, CAST(row_number() OVER (PARTITION BY floor(page_id / 100.0) ORDER BY page_id) AS INT) AS nth FROM (SELECT DISTINCT page_id FROM e)")

# versions


add("sta06_discard", lambda s, d: edited(elements(s, d)).select("page_id", "pos").join(elements(s, d).select("page_id", "pos"), ["page_id", "pos"], "left_anti"), f"WITH {ELEMENTS}{EDITED} SELECT page_id, pos FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = f.page_id AND e.pos = f.pos)")
simple("sta09_unsuppress", lambda e: e.where(TEXTS).withColumn("shown", F.max(F.col("visible").cast("int")).over(Window.partitionBy("page_id", "text"))).select("page_id", "pos", (F.col("visible") | (F.col("shown") == 0)).alias("visible")), "SELECT page_id, pos, visible OR max(CAST(visible AS INT)) OVER (PARTITION BY page_id, text) = 0 AS visible FROM e WHERE type = 'text'")



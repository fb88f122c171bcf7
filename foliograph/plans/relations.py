"""Queries of joins and set operations on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import relations as R
from ..sources.views import ELEMENTS, OCR_LINES, elements, ocr_lines
from .geometry import AREA_A, AREA_B, CX, CY, DIST, EDGES, INTER
from .registry import query

COLS = ("pos", "element_id", "type", "text", "z_index", "confidence", "visible", "group_id", "width", "height", *EDGES)


def q(where: str, left: str = "true", right: str = "true") -> str:
    """Pairs a_*, b_* of one page as the table q; left and right choose among e."""
    cols = ", ".join(f"{t}.{c} AS {t}_{c}" for t in "ab" for c in COLS)
    return f"WITH {ELEMENTS}, q0 AS (SELECT a.page_id, {cols} FROM (SELECT * FROM e WHERE {left}) a JOIN (SELECT * FROM e WHERE {right}) b ON a.page_id = b.page_id), q AS (SELECT * FROM q0 WHERE {where})"


TEXTS, IMAGES, RECTS = "type = 'text'", "type = 'image'", "type = 'rectangle'"
COVER_A, COVER_B = f"{INTER} / greatest({AREA_A}, 1.0)", f"{INTER} / greatest({AREA_B}, 1.0)"
OVERLAP = f"{INTER} / greatest(least({AREA_A}, {AREA_B}), 1.0)"
IOU = f"{INTER} / greatest({AREA_A} + {AREA_B} - {INTER}, 1.0)"
D2 = f"(({CX['a']} - {CX['b']}) * ({CX['a']} - {CX['b']}) + ({CY['a']} - {CY['b']}) * ({CY['a']} - {CY['b']}))"
A, B = (lambda: G.box("a_")), (lambda: G.box("b_"))


def edited(e: DataFrame) -> DataFrame:
    """A second version of a page: some rows moved, some gone, some new."""
    moved = e.where("element_id % 13 <> 0").withColumn("x1", F.when(F.col("element_id") % 5 == 0, F.col("x1") + 3).otherwise(F.col("x1"))).withColumn("x2", F.col("x1") + F.col("width"))
    return moved.unionByName(e.where("element_id % 29 = 0").withColumn("pos", F.col("pos") + 100))


EDITED = """, f AS (SELECT * REPLACE (CASE WHEN element_id % 5 = 0 THEN x1 + 3 ELSE x1 END AS x1, CASE WHEN element_id % 5 = 0 THEN x1 + 3 ELSE x1 END + width AS x2) FROM e WHERE element_id % 13 <> 0
  UNION ALL SELECT * REPLACE (pos + 100 AS pos) FROM e WHERE element_id % 29 = 0)"""


@query("joi01_overlay", f"WITH {ELEMENTS}{EDITED} SELECT coalesce(e.page_id, f.page_id) AS page_id, coalesce(e.pos, f.pos) AS pos, coalesce(f.x1, e.x1) AS x1, coalesce(f.text, e.text) AS text FROM e FULL JOIN f ON e.page_id = f.page_id AND e.pos = f.pos")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    f = edited(e).select("page_id", "pos", F.col("x1").alias("nx"), F.col("text").alias("nt"))
    return e.select("page_id", "pos", "x1", "text").join(f, ["page_id", "pos"], "full").select("page_id", "pos", F.coalesce("nx", "x1").alias("x1"), F.coalesce("nt", "text").alias("text"))


@query(
    "joi02_tiered_match",
    f"""WITH {ELEMENTS}, v AS (SELECT page_id, pos, text, row_number() OVER (PARTITION BY page_id, text ORDER BY pos) AS n FROM e WHERE type = 'text' AND pos >= 20),
    t AS (SELECT page_id, pos, text, row_number() OVER (PARTITION BY page_id, text ORDER BY pos) AS n FROM e WHERE type = 'text' AND pos < 20),
    m AS (SELECT t.page_id, t.pos, v.pos AS match, 1 AS tier FROM t JOIN v ON t.page_id = v.page_id AND t.text = v.text AND t.n = v.n),
    tr AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = t.page_id AND m.pos = t.pos)),
    vr AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM v WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = v.page_id AND m.match = v.pos))
    SELECT * FROM m UNION ALL SELECT tr.page_id, tr.pos, vr.pos AS match, 2 AS tier FROM tr JOIN vr ON tr.page_id = vr.page_id AND tr.n = vr.n""",
)
def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the first half of a page with those of the second: equal texts first, then what is left by rank."""
    from pyspark.sql import Window

    texts = elements(spark, sf_dir).where(TEXTS).select("page_id", "pos", "text")
    by_text, by_page = Window.partitionBy("page_id", "text").orderBy("pos"), Window.partitionBy("page_id").orderBy("pos")
    t = texts.where("pos < 20").withColumn("n", F.row_number().over(by_text))
    v = texts.where("pos >= 20").withColumn("n", F.row_number().over(by_text)).withColumnRenamed("pos", "match")
    m = t.join(v, ["page_id", "text", "n"]).select("page_id", "pos", "match", F.lit(1).alias("tier"))
    left = t.join(m, ["page_id", "pos"], "left_anti").withColumn("n", F.row_number().over(by_page)).select("page_id", "n", "pos")
    right = v.join(m, ["page_id", "match"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("match"))).select("page_id", "n", "match")
    return m.union(left.join(right, ["page_id", "n"]).select("page_id", "pos", "match", F.lit(2).alias("tier")))


GAP = "greatest(greatest(a_x1 - b_x2, b_x1 - a_x2, 0.0), greatest(a_y1 - b_y2, b_y1 - a_y2, 0.0))"
RELATIONS = q("a_pos < b_pos") + f""", r AS (
  SELECT page_id, a_pos, b_pos, CASE WHEN {COVER_B} >= 0.98 OR {COVER_A} >= 0.98 THEN 'contains' WHEN {GAP} <= 1.4 * greatest(least(a_x2 - a_x1, a_y2 - a_y1, b_x2 - b_x1, b_y2 - b_y1), 1.0) THEN 'near' END AS kind FROM q
  UNION ALL SELECT page_id, a_pos, b_pos, 'x_aligned' FROM q WHERE abs({CX['a']} - {CX['b']}) <= 4
  UNION ALL SELECT page_id, a_pos, b_pos, 'y_aligned' FROM q WHERE abs({CY['a']} - {CY['b']}) <= 4)"""  # fmt: skip


@query("joi03_relations", RELATIONS + " SELECT page_id, a_pos, b_pos, kind, CASE kind WHEN 'contains' THEN 0.78 WHEN 'near' THEN 0.55 ELSE 0.62 END AS confidence FROM r WHERE kind IS NOT NULL")
def all_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relations(elements(spark, sf_dir))


@query("joi04_containers", q("a_pos <> b_pos AND b_x1 >= a_x1 AND b_y1 >= a_y1 AND b_x2 <= a_x2 AND b_y2 <= a_y2", RECTS) + " SELECT page_id, b_pos AS pos, max(a_pos) AS container FROM q GROUP BY page_id, b_pos")
def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.containers(elements(spark, sf_dir))


def _arg(key: str, order: str, take: str) -> str:
    """The pairs first by order for each key."""
    return f" SELECT {key}, {take} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM q) WHERE rn = 1"


@query("joi05_icon_text", q(f"{CX['b']} >= {CX['a']} AND {DIST} <= 300", "type = 'ellipse'", TEXTS) + _arg("page_id, a_pos", f"{D2}, b_pos", f"b_pos, {D2} AS distance2"))
def icon_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    (ax, _), (bx, _) = G.center(A()), G.center(B())
    return R.nearest(e.where("type = 'ellipse'"), e.where(TEXTS), (bx >= ax) & (G.center_distance(A(), B()) <= 300))


@query("joi06_nearest_same_label", q("a_pos <> b_pos AND a_type = b_type") + _arg("page_id, a_pos", f"{D2}, b_pos", f"b_pos, {D2} AS distance2"))
def nearest_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.nearest(e, e, (F.col("a_type") == F.col("b_type")) & (F.col("a_pos") != F.col("b_pos")))


@query("joi06_nearest_in_rings", q("a_pos <> b_pos AND a_type = b_type") + _arg("page_id, a_pos", f"{D2}, b_pos", f"b_pos, {D2} AS distance2"))
def nearest_same_in_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cells and widening rings instead of all pairs of a page."""
    e = elements(spark, sf_dir)
    return R.nearest_in_rings(e, e, "type").drop("looked")


@query("joi07_nearest_badge", q("abs(a_y1 - b_y1) <= 60 OR b_y1 >= a_y2", TEXTS, "type = 'ellipse'") + _arg("page_id, a_pos", f"{D2}, b_pos", f"b_pos, {D2} AS distance2"))
def nearest_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.nearest(e.where(TEXTS), e.where("type = 'ellipse'"), (F.abs(A().y1 - B().y1) <= 60) | (B().y1 >= A().y2))


@query("joi08_snap", q(f"{AREA_B} / {AREA_A} BETWEEN 0.2 AND 5.0 AND {OVERLAP} >= 0.30", TEXTS, IMAGES) + _arg("page_id, a_pos", f"-({OVERLAP} * b_confidence), b_pos", f"b_pos, {OVERLAP} * b_confidence AS score"))
def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.snapped(e.where(TEXTS), e.where(IMAGES))


@query("joi09_text_in_badge", q(f"{COVER_A} >= 0.85 AND a_pos <> b_pos", TEXTS, "type = 'ellipse'") + " SELECT DISTINCT page_id, a_pos AS pos FROM q")
def in_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.covered(e.where(TEXTS), e.where("type = 'ellipse'"), 0.85).select("page_id", "pos")


@query("joi10_covered_by_asset", q(f"a_pos <> b_pos AND ({COVER_A} >= 0.60 OR (b_type = 'image' AND {OVERLAP} >= 0.45) OR (b_type <> 'image' AND {IOU} >= 0.45))", TEXTS, "type <> 'text'") + " SELECT page_id, a_pos, b_pos FROM q")
def covered_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    image = F.col("b_type") == "image"
    on = (G.coverage(A(), B()) >= 0.60) | (image & (G.overlap_min(A(), B()) >= 0.45)) | (~image & (G.iou(A(), B()) >= 0.45))
    return R.pairs(e.where(TEXTS), e.where("type <> 'text'"), on).select("page_id", "a_pos", "b_pos")


@query("joi11_plate_members", q(f"a_pos <> b_pos AND {CX['b']} BETWEEN a_x1 AND a_x2 AND {CY['b']} BETWEEN a_y1 AND a_y2 AND {AREA_B} <= 0.85 * {AREA_A}", RECTS) + " SELECT page_id, a_pos AS plate, array_to_string(list(b_pos ORDER BY b_pos), ',') AS members FROM q GROUP BY page_id, a_pos")
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    p = R.pairs(e.where(RECTS), e, G.center_inside(B(), A()) & (G.area(B()) <= 0.85 * G.area(A())) & (F.col("a_pos") != F.col("b_pos")))
    return p.groupBy("page_id", F.col("a_pos").alias("plate")).agg(F.array_join(F.sort_array(F.collect_list("b_pos")).cast("array<string>"), ",").alias("members"))


@query("joi13_badge_owner", q(f"a_pos <> b_pos AND {OVERLAP} >= 0.72", "type <> 'ellipse'", "type = 'ellipse'") + " SELECT page_id, a_pos AS pos, max(b_pos) AS owner FROM q GROUP BY page_id, a_pos")
def badge_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    p = R.pairs(e.where("type <> 'ellipse'"), e.where("type = 'ellipse'"), G.overlap_min(A(), B()) >= 0.72)
    return p.groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.max("b_pos").alias("owner"))


@query("joi14_smallest_owner", q(f"{COVER_A} >= 0.75", TEXTS, IMAGES) + _arg("page_id, a_pos", f"{AREA_B}, b_pos", "b_pos"))
def smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.smallest_owner(e.where(TEXTS), e.where(IMAGES))


@query("joi15_first_owner", q(f"{COVER_A} > 0.20 AND a_pos <> b_pos", TEXTS, "type <> 'text'") + f" SELECT page_id, a_pos AS pos, min(CASE WHEN {COVER_A} >= 0.85 THEN b_pos END) AS owner, count(*) AS touching FROM q GROUP BY page_id, a_pos")
def first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    p = R.pairs(e.where(TEXTS), e.where("type <> 'text'"), G.coverage(A(), B()) > 0.20)
    return p.groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.min(F.when(G.coverage(A(), B()) >= 0.85, F.col("b_pos"))).alias("owner"), F.count("*").alias("touching"))


@query("joi17_issue_lookup", f"WITH {ELEMENTS}, i AS (SELECT event_id + 7 AS element_id, event_id AS issue FROM events WHERE event_id % 9 = 0) SELECT issue, e.pos IS NOT NULL AS applied, e.type FROM i LEFT JOIN e ON i.element_id = e.element_id")
def issue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    issues = e.where("element_id % 9 = 0").select(F.col("element_id").alias("issue"), (F.col("element_id") + 7).alias("element_id"))
    return issues.join(e.select("element_id", "pos", "type"), "element_id", "left").select("issue", F.col("pos").isNotNull().alias("applied"), "type")


@query("joi18_preserved", q(f"a_pos <> b_pos AND {OVERLAP} >= 0.55", TEXTS, "confidence >= 0.5 AND type <> 'text'") + " SELECT DISTINCT page_id, a_pos AS pos FROM q")
def preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.pairs(e.where(TEXTS), e.where("confidence >= 0.5 AND type <> 'text'"), G.overlap_min(A(), B()) >= 0.55).select("page_id", F.col("a_pos").alias("pos")).distinct()


@query("joi19_uncovered_region", q("true", RECTS, IMAGES) + f", m AS (SELECT page_id, a_pos, max({COVER_A}) AS best FROM q GROUP BY page_id, a_pos) SELECT e.page_id, e.pos, coalesce(m.best, 0.0) AS best FROM e LEFT JOIN m ON e.page_id = m.page_id AND e.pos = m.a_pos WHERE e.type = 'rectangle' AND coalesce(m.best, 0.0) < 0.6")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    most = R.pairs(e.where(RECTS), e.where(IMAGES)).groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.max(G.coverage(A(), B())).alias("most"))
    met = e.where(RECTS).select("page_id", "pos").join(most, ["page_id", "pos"], "left")  # every rectangle is a row, also those of one place
    return met.select("page_id", "pos", F.coalesce("most", F.lit(0.0)).alias("best")).where("best < 0.6")


@query("joi20_reconcile", f"WITH {ELEMENTS}{EDITED} SELECT coalesce(e.page_id, f.page_id) AS page_id, coalesce(e.pos, f.pos) AS pos, CASE WHEN e.pos IS NULL THEN 'added' WHEN f.pos IS NULL THEN 'lost' WHEN e.x1 = f.x1 AND e.y1 = f.y1 AND e.x2 = f.x2 AND e.y2 = f.y2 AND e.type = f.type THEN 'kept' ELSE 'changed' END AS status FROM e FULL JOIN f ON e.page_id = f.page_id AND e.pos = f.pos")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.reconciled(e, edited(e))


_BOUNDS = "x2 > 960 OR y2 > 540"


@query("joi21_issue_delta", f"WITH {ELEMENTS}{EDITED} SELECT page_id, pos, 'new' AS what FROM (SELECT page_id, pos FROM f WHERE {_BOUNDS} EXCEPT SELECT page_id, pos FROM e WHERE {_BOUNDS}) UNION ALL SELECT page_id, pos, 'gone' FROM (SELECT page_id, pos FROM e WHERE {_BOUNDS} EXCEPT SELECT page_id, pos FROM f WHERE {_BOUNDS})")
def issue_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    was, now = (d.where(_BOUNDS).select("page_id", "pos") for d in (e, edited(e)))
    return now.exceptAll(was).withColumn("what", F.lit("new")).union(was.exceptAll(now).withColumn("what", F.lit("gone")))


@query("joi22_grid_overlap", q("a_pos < b_pos AND least(a_x2, b_x2) > greatest(a_x1, b_x1) AND least(a_y2, b_y2) > greatest(a_y1, b_y1)") + f" SELECT page_id, a_pos, b_pos, {INTER} AS common FROM q")
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.overlapping(e, e).where("a_pos < b_pos").select("page_id", "a_pos", "b_pos", G.intersection(A(), B()).alias("common"))


@query("joi23_uncovered_text", q(f"{CX['a']} BETWEEN b_x1 AND b_x2 AND {CY['a']} BETWEEN b_y1 AND b_y2", TEXTS, RECTS) + " SELECT page_id, pos FROM e WHERE type = 'text' AND NOT EXISTS (SELECT 1 FROM q WHERE q.page_id = e.page_id AND q.a_pos = e.pos)")
def uncovered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    inside = R.pairs(e.where(TEXTS), e.where(RECTS), G.center_inside(A(), B())).select("page_id", F.col("a_pos").alias("pos"))
    return e.where(TEXTS).select("page_id", "pos").join(inside, ["page_id", "pos"], "left_anti")


@query("joi24_z_owner", f"WITH {ELEMENTS} SELECT t.page_id, t.pos FROM e t JOIN e o ON t.owned_by = o.element_id AND t.page_id = o.page_id WHERE t.z_index <= o.z_index")
def z_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    owner = e.select("page_id", F.col("element_id").alias("owned_by"), F.col("z_index").alias("oz"))
    return e.join(owner, ["page_id", "owned_by"]).where("z_index <= oz").select("page_id", "pos")


@query("fil12_glyph_candidate", q(f"{AREA_A} <= 0.45 * {AREA_B} AND {COVER_A} >= 0.90 AND a_pos <> b_pos", "type <> 'text'", TEXTS) + " SELECT DISTINCT page_id, a_pos AS pos FROM q")
def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return R.pairs(e.where("type <> 'text'"), e.where(TEXTS), (G.area(A()) <= 0.45 * G.area(B())) & (G.coverage(A(), B()) >= 0.90)).select("page_id", F.col("a_pos").alias("pos")).distinct()


@query("set01_ordered_ids", "WITH " + ELEMENTS + " SELECT page_id, pos, CASE WHEN group_id IS NULL OR group_id = type THEN type ELSE type || ',' || group_id END AS ids FROM e")
def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("page_id", "pos", F.array_join(F.array_distinct(F.array_compact(F.array("type", "group_id", "type"))), ",").alias("ids"))


@query("set02_last_wins", f"WITH {ELEMENTS} SELECT page_id, type, group_id, max(pos) AS pos, arg_max(z_index, pos) AS z FROM e WHERE group_id IS NOT NULL GROUP BY page_id, type, group_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).where("group_id IS NOT NULL").groupBy("page_id", "type", "group_id").agg(F.max("pos").alias("pos"), F.max_by("z_index", "pos").alias("z"))


@query("set03_group_merge", f"WITH {ELEMENTS}{EDITED}, a AS (SELECT page_id, group_id, count(*) AS n FROM e WHERE group_id IS NOT NULL GROUP BY ALL), b AS (SELECT page_id, group_id, count(*) AS n FROM f WHERE group_id IS NOT NULL AND pos % 2 = 0 GROUP BY ALL) SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.group_id, b.group_id) AS group_id, coalesce(b.n, a.n) AS n FROM a FULL JOIN b ON a.page_id = b.page_id AND a.group_id = b.group_id")
def group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    key = ["page_id", "group_id"]
    a = e.where("group_id IS NOT NULL").groupBy(*key).agg(F.count("*").alias("a"))
    b = edited(e).where("group_id IS NOT NULL AND pos % 2 = 0").groupBy(*key).agg(F.count("*").alias("b"))
    return a.join(b, key, "full").select(*key, F.coalesce("b", "a").alias("n"))


@query("set04_new_only", f"WITH {ELEMENTS}{EDITED} SELECT page_id, pos FROM e UNION ALL SELECT page_id, pos FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = f.page_id AND e.pos = f.pos)")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir).select("page_id", "pos")
    return e.union(edited(elements(spark, sf_dir)).select("page_id", "pos").join(e, ["page_id", "pos"], "left_anti"))


@query("set05_duplicates", q(f"a_pos < b_pos AND a_type = b_type AND a_text IS NOT DISTINCT FROM b_text AND {OVERLAP} > 0.7") + f" SELECT page_id, a_pos, b_pos, {OVERLAP} AS overlap FROM q")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.pairs(elements(spark, sf_dir), on=(F.col("a_type") == F.col("b_type")) & F.col("a_text").eqNullSafe(F.col("b_text")) & (G.overlap_min(A(), B()) > 0.7))
    return p.select("page_id", "a_pos", "b_pos", G.overlap_min(A(), B()).alias("overlap"))


@query("set06_heavy_overlap", q(f"a_pos < b_pos AND a_group_id IS DISTINCT FROM b_group_id AND {OVERLAP} > 0.92", "type <> 'text'", "type <> 'text'") + " SELECT page_id, a_pos, b_pos FROM q")
def heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.pairs(elements(spark, sf_dir).where("type <> 'text'"), on=~F.col("a_group_id").eqNullSafe(F.col("b_group_id")) & (G.overlap_min(A(), B()) > 0.92))
    return p.select("page_id", "a_pos", "b_pos")


@query("set07_text_overlap", q(f"a_pos < b_pos AND {OVERLAP} > 0.25", TEXTS, TEXTS) + f" SELECT page_id, a_pos, b_pos, {OVERLAP} AS overlap FROM q")
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairs(elements(spark, sf_dir).where(TEXTS), on=G.overlap_min(A(), B()) > 0.25).select("page_id", "a_pos", "b_pos", G.overlap_min(A(), B()).alias("overlap"))


@query("set08_concatenate", f"WITH {ELEMENTS}, {OCR_LINES} SELECT page_id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM (SELECT page_id, type AS kind FROM e UNION ALL SELECT page_id, role FROM o) GROUP BY page_id")
def concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = elements(spark, sf_dir).select("page_id", F.col("type").alias("kind")).unionByName(ocr_lines(spark, sf_dir).select("page_id", F.col("role").alias("kind")))
    return both.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query("set10_id_sets", f"WITH {ELEMENTS}{EDITED} SELECT (SELECT count(*) FROM (SELECT page_id, pos FROM e INTERSECT SELECT page_id, pos FROM f)) AS both, (SELECT count(*) FROM (SELECT page_id, pos FROM e EXCEPT SELECT page_id, pos FROM f)) AS lost")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    a, b = e.select("page_id", "pos"), edited(e).select("page_id", "pos")
    return a.intersect(b).agg(F.count("*").alias("both")).crossJoin(a.subtract(b).agg(F.count("*").alias("lost")))

"""Queries of the box algebra, over elements and over neighbours on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.views import ELEMENTS, elements
from .registry import columns, query

W, H = 960, 540
EDGES = ("x1", "y1", "x2", "y2")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element, a, with the next one of its page, b."""
    e = elements(spark, sf_dir)
    keep = ["element_id", "type", "text", "z_index", "confidence", "visible", *EDGES]
    a = e.select("page_id", "pos", *(F.col(c).alias(f"a_{c}") for c in keep))
    b = e.select("page_id", (F.col("pos") - 1).alias("pos"), *(F.col(c).alias(f"b_{c}") for c in keep))
    return a.join(b, ["page_id", "pos"])


PAIRS = ELEMENTS + """,
p AS (SELECT a.page_id, a.pos, """ + ", ".join(f"{t}.{c} AS {t}_{c}" for t in "ab" for c in ("element_id", "type", "text", "z_index", "confidence", "visible", *EDGES)) + """
  FROM e a JOIN e b ON a.page_id = b.page_id AND b.pos = a.pos + 1)"""  # fmt: skip

KEY = ["page_id", "pos"]
A, B = (lambda: G.box("a_")), (lambda: G.box("b_"))
INTER = "greatest(least(a_x2, b_x2) - greatest(a_x1, b_x1), 0) * greatest(least(a_y2, b_y2) - greatest(a_y1, b_y1), 0)"
AREA_A, AREA_B = "((a_x2 - a_x1) * (a_y2 - a_y1))", "((b_x2 - b_x1) * (b_y2 - b_y1))"
CX = {t: f"({t}_x1 + ({t}_x2 - {t}_x1) / 2)" for t in "ab"}
CY = {t: f"({t}_y1 + ({t}_y2 - {t}_y1) / 2)" for t in "ab"}
DIST = f"sqrt(({CX['a']} - {CX['b']}) * ({CX['a']} - {CX['b']}) + ({CY['a']} - {CY['b']}) * ({CY['a']} - {CY['b']}))"


def one(name: str, made, sql: dict[str, str], where=None) -> None:
    columns(name, elements, KEY, made, ELEMENTS, "e", sql, where)


def two(name: str, made, sql: dict[str, str], where=None) -> None:
    columns(name, neighbours, KEY, made, PAIRS, "p", sql, where)


def edges(b: G.Box) -> dict:
    return dict(zip(EDGES, b, strict=True))


def _clipped() -> G.Box:
    """Boxes moved so that edges have fractions and some leave the canvas."""
    b = G.box()
    return G.clip(G.Box(b.x1 / 3 - 20, b.y1 / 3 - 20, b.x2 * 1.25, b.y2 * 1.25), W, H)


CLIP = {c: f"least(greatest(round_even({c} {by}, 0), 0.0), {most}.0) + 0.0" for c, by, most in (("x1", "/ 3 - 20", W), ("y1", "/ 3 - 20", H), ("x2", "* 1.25", W), ("y2", "* 1.25", H))}

one("geo01_box", lambda: edges(G.from_size(F.col("x1"), F.col("y1"), F.when(F.col("pos") % 7 != 0, F.col("width")), F.col("height"))), {"x1": "x1", "y1": "y1", "x2": "x1 + CASE WHEN pos % 7 <> 0 THEN width ELSE 0 END", "y2": "y1 + height"})
one("geo02_clip", lambda: {**edges(_clipped()), "empty": G.is_empty(_clipped())}, {**CLIP, "empty": f"({CLIP['x2']}) <= ({CLIP['x1']}) OR ({CLIP['y2']}) <= ({CLIP['y1']})"})
one("geo03_area", lambda: {"area": G.area(G.box())}, {"area": "greatest(x2 - x1, 0) * greatest(y2 - y1, 0)"})
two("geo04_intersects", lambda: {"meets": G.intersects(A(), B())}, {"meets": "least(a_x2, b_x2) > greatest(a_x1, b_x1) AND least(a_y2, b_y2) > greatest(a_y1, b_y1)"})
two("geo05_intersection", lambda: {"common": G.intersection(A(), B())}, {"common": INTER})
two("geo06_coverage", lambda: {"coverage": G.coverage(A(), B())}, {"coverage": f"{INTER} / greatest({AREA_A}, 1.0)"})
two("geo07_overlap_min", lambda: {"overlap": G.overlap_min(A(), B())}, {"overlap": f"{INTER} / greatest(least({AREA_A}, {AREA_B}), 1.0)"})
two("geo08_iou", lambda: {"iou": G.iou(A(), B())}, {"iou": f"{INTER} / greatest({AREA_A} + {AREA_B} - {INTER}, 1.0)"})
two("geo09_union", lambda: edges(G.union(A(), B())), {"x1": "least(a_x1, b_x1)", "y1": "least(a_y1, b_y1)", "x2": "greatest(a_x2, b_x2)", "y2": "greatest(a_y2, b_y2)"})
one("geo10_center", lambda: dict(zip(("cx", "cy"), G.center(G.box()), strict=True)), {"cx": "x1 + (x2 - x1) / 2", "cy": "y1 + (y2 - y1) / 2"})
two("geo11_center_in_box", lambda: {"inside": G.center_inside(A(), B())}, {"inside": f"{CX['a']} BETWEEN b_x1 AND b_x2 AND {CY['a']} BETWEEN b_y1 AND b_y2"})
U, V = f"(({CX['a']} - {CX['b']}) / greatest((b_x2 - b_x1) / 2, 1.0))", f"(({CY['a']} - {CY['b']}) / greatest((b_y2 - b_y1) / 2, 1.0))"
two("geo12_center_in_ellipse", lambda: {"inside": G.center_in_ellipse(A(), B())}, {"inside": f"{U} * {U} + {V} * {V} <= 0.82"})
SIDE = "greatest(least(a_x2 - a_x1, a_y2 - a_y1, b_x2 - b_x1, b_y2 - b_y1), 8.0)"
two("geo13_near", lambda: {"distance": G.center_distance(A(), B()), "near": G.near(A(), B())}, {"distance": DIST, "near": f"{DIST} <= {SIDE} * 1.6 + greatest(a_x2 - a_x1, b_x2 - b_x1) * 0.75"})


def _shares() -> G.Box:
    return G.normalised_to_pixels(F.col("x1") / 1024, F.col("y1") / 512, F.col("width") / 256, F.col("height") / 128, W, H)


_L, _T, _RW, _RH = "(x1 / 1024)", "(y1 / 512)", "(width / 256)", "(height / 128)"
_P = {"x1": f"least(greatest(round_even({_L} * {W}, 0), 0.0), {W}.0)", "y1": f"least(greatest(round_even({_T} * {H}, 0), 0.0), {H}.0)", "x2": f"least(greatest(round_even(({_L} + {_RW}) * {W}, 0), 0.0), {W}.0)", "y2": f"least(greatest(round_even(({_T} + {_RH}) * {H}, 0), 0.0), {H}.0)"}
_OK = f"{_L} >= 0 AND {_L} < 1 AND {_T} >= 0 AND {_T} < 1 AND {_RW} > 0 AND {_RH} > 0 AND {_L} + {_RW} <= 1.01 AND {_T} + {_RH} <= 1.01 AND {_RW} * {_RH} <= 0.8 AND {_P['x2']} - {_P['x1']} >= 24 AND {_P['y2']} - {_P['y1']} >= 24"
one("geo14_normalised_to_pixels", lambda: edges(_shares()), {k: f"CASE WHEN {_OK} THEN {v} END" for k, v in _P.items()})


def _parsed() -> dict:
    """Boxes said in two ways: an object of left, top, width, height, or an array of edges."""
    said = F.when(F.col("pos") % 2 == 0, F.to_json(F.struct(F.col("x1").alias("left"), F.col("y1").alias("top"), "width", "height"))).otherwise(F.to_json(F.array(*EDGES)))
    o = F.from_json(said, "left double, top double, width double, height double")
    a = F.from_json(F.when(said.startswith("["), said), "array<double>")
    return {"x1": F.coalesce(a[0], o["left"]), "y1": F.coalesce(a[1], o["top"]), "x2": F.coalesce(a[2], o["left"] + o["width"]), "y2": F.coalesce(a[3], o["top"] + o["height"])}


one("geo15_bbox_payload", _parsed, {c: c for c in EDGES})
two("geo16_bounded_move", lambda: {"x": G.bounded_move(F.col("a_x1"), F.col("b_x1"), F.lit(28.8), F.lit(0.0), F.lit(900.0))}, {"x": "least(greatest(greatest(a_x1 - 28.8, least(a_x1 + 28.8, b_x1)), 0.0), 900.0)"})
two("geo21_text_displacement", lambda: {"moved": G.displacement(A(), B()), "score": F.greatest(F.lit(0.0), 1 - G.displacement(A(), B()) / 1.5), "issue": G.displacement(A(), B()) > 0.6}, {"moved": "greatest(abs(a_x1 - b_x1), abs(a_y1 - b_y1)) / greatest(b_y2 - b_y1, 8.0)", "score": "greatest(0.0, 1 - greatest(abs(a_x1 - b_x1), abs(a_y1 - b_y1)) / greatest(b_y2 - b_y1, 8.0) / 1.5)", "issue": "greatest(abs(a_x1 - b_x1), abs(a_y1 - b_y1)) / greatest(b_y2 - b_y1, 8.0) > 0.6"})
_IN = f"greatest(least(x2, {W}.0) - greatest(x1, 0.0), 0) * greatest(least(y2, {H}.0) - greatest(y1, 0.0), 0) / greatest((x2 - x1) * (y2 - y1), 1.0)"
one("geo22_in_canvas", lambda: {"share": G.in_canvas(G.box(), W, H), "issue": G.in_canvas(G.box(), W, H) < 0.9}, {"share": _IN, "issue": f"{_IN} < 0.9"})
two("geo23_aspect_distortion", lambda: {"issue": G.aspect_distortion(A(), B()) > 0.18}, {"issue": "abs(ln(((a_x2 - a_x1) / (a_y2 - a_y1)) / ((b_x2 - b_x1) / (b_y2 - b_y1)))) > 0.18"})
one("geo24_out_of_bounds", lambda: {"bad": ~((F.col("x1") >= -2) & (F.col("y1") >= -2) & (F.col("x2") <= W + 2) & (F.col("y2") <= H + 2)) & (F.col("type") != "image")}, {"bad": f"NOT (x1 >= -2 AND y1 >= -2 AND x2 <= {W + 2} AND y2 <= {H + 2}) AND type <> 'image'"})


def _saned() -> dict:
    x = F.when(F.col("pos") % 9 == 0, F.lit(float("nan"))).when(F.col("pos") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("x1") * 1.5 - 50)
    w = F.when(F.col("pos") % 5 == 0, F.lit(None)).otherwise(F.col("width"))
    wide = G.sane(w, 1, W)
    return {"w": wide, "x": G.sane(x, -2, W - wide + 2)}


_W = f"least(greatest(CASE WHEN pos % 5 = 0 THEN 0 ELSE width END, 1.0), {W}.0)"
one("geo25_sanitise", _saned, {"w": _W, "x": f"least(greatest(CASE WHEN pos % 9 = 0 OR pos % 11 = 0 THEN 0 ELSE x1 * 1.5 - 50 END, -2.0), {W} - {_W} + 2)"})
one("geo26_px_to_pt", lambda: {"inches": F.col("width") * (13.333 / W), "points": F.greatest(F.lit(5.0), F.col("height") * (13.333 / W) * 72)}, {"inches": f"width * {13.333 / W!r}", "points": f"greatest(5.0, height * {13.333 / W!r} * 72)"})


def _grown() -> G.Box:
    b = G.box()
    return G.Box(b.x1 - F.col("pos") * 20, b.y1 - F.col("pos") * 12, b.x2 + F.col("pos") * 20, b.y2 + F.col("pos") * 12)


_B = {"x1": "(x1 - pos * 20)", "y1": "(y1 - pos * 12)", "x2": "(x2 + pos * 20)", "y2": "(y2 + pos * 12)"}
_SH = f"(({_B['x2']} - {_B['x1']}) * ({_B['y2']} - {_B['y1']}) / {W * H}.0)"
_ED = f"(CAST({_B['x1']} <= {0.03 * W!r} AS INT) + CAST({_B['y1']} <= {0.03 * H!r} AS INT) + CAST({_B['x2']} >= {0.97 * W!r} AS INT) + CAST({_B['y2']} >= {0.97 * H!r} AS INT))"
one("geo27_page_environment", lambda: {"page": G.is_page_environment(_grown(), W, H)}, {"page": f"{_SH} >= 0.75 OR ({_B['x2']} - {_B['x1']} >= {0.88 * W!r} AND {_B['y2']} - {_B['y1']} >= {0.70 * H!r}) OR ({_ED} >= 3 AND {_SH} >= 0.45)"})
one("geo28_page_wash", lambda: {"wash": (_grown().x1 <= 0.03 * W) & (_grown().y1 <= 0.03 * H) & (_grown().x2 >= 0.97 * W) & (_grown().y2 >= 0.97 * H) & (F.col("confidence") >= 0.5)}, {"wash": f"{_ED} = 4 AND confidence >= 0.5"})
one("geo29_stroke", lambda: {"stroke": G.is_stroke(G.Box(F.col("x1"), F.col("y1"), F.col("x1") + F.col("width"), F.col("y1") + F.floor(F.col("height") / 16)), F.col("width") * 0.6, W, H)}, {"stroke": f"least(width, floor(height / 16)) <= 3 AND greatest(width, floor(height / 16)) >= {max(24.0, 0.06 * W)!r} AND greatest(width, floor(height / 16)) / greatest(least(width, floor(height / 16)), 1.0) >= 8 AND width * 0.6 >= greatest(12.0, 0.55 * greatest(width, floor(height / 16)))"})
one("geo30_circularity", lambda: {"round": (G.circularity(F.col("width") * F.col("height"), 2 * (F.col("width") + F.col("height"))) >= 0.7)}, {"round": "4 * pi() * (width * height) / greatest(4 * (width + height) * (width + height), 1.0) >= 0.7"})


def _source() -> dict:
    raw = F.when(F.col("pos") % 3 == 0, F.array(*(F.col(c) + 2 for c in EDGES))).when(F.col("pos") % 3 == 1, F.array(F.col("x1")))
    good = F.coalesce((F.size(raw) == 4) & (F.get(raw, F.lit(2)) > F.get(raw, F.lit(0))) & (F.get(raw, F.lit(3)) > F.get(raw, F.lit(1))), F.lit(False))
    return {c: F.when(good, F.get(raw, F.lit(k))).otherwise(F.col(c)) for k, c in enumerate(EDGES)}


one("geo31_text_source_box", _source, {c: f"CASE WHEN pos % 3 = 0 THEN {c} + 2 ELSE {c} END" for c in EDGES})
_FR = {"x": "(b_x2 - b_x1)", "y": "(b_y2 - b_y1)"}
two("geo32_to_asset", lambda: edges(G.to_asset(A(), B(), F.lit(200.0), F.lit(100.0))), {c: f"least(greatest(round_even((a_{c} - b_{c[0]}1) * {size} / greatest({_FR[c[0]]}, 1.0), 0), 0.0), {size})" for c, size in zip(EDGES, ("200.0", "100.0", "200.0", "100.0"), strict=True)})
two("geo33_overlaps_some", lambda: {"some": G.overlap_min(A(), B()) >= 0.15}, {"some": f"{INTER} / greatest(least({AREA_A}, {AREA_B}), 1.0) >= 0.15"})
two("geo34_compact_cover", lambda: {"cover": (G.coverage(A(), B()) >= 0.5) & (G.area(B()) <= 4 * G.area(A()))}, {"cover": f"{INTER} / greatest({AREA_A}, 1.0) >= 0.5 AND {AREA_B} <= 4 * {AREA_A}"})


@query(
    "geo17_expanded_box",
    f"""WITH {ELEMENTS},
    s AS (SELECT *, least(12.0, greatest(2.0, 0.05 * width)) AS px, greatest(2.0, 0.25 * height) AS py FROM e WHERE type = 'text'),
    n AS (SELECT a.page_id, a.pos,
      max(CASE WHEN b.x2 <= a.x1 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0.25 * least(a.height, b.height) THEN (b.x2 + a.x1) / 2 END) AS l,
      min(CASE WHEN b.x1 >= a.x2 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0.25 * least(a.height, b.height) THEN (b.x1 + a.x2) / 2 END) AS r,
      max(CASE WHEN b.y2 <= a.y1 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0.25 * least(a.width, b.width) THEN (b.y2 + a.y1) / 2 END) AS t,
      min(CASE WHEN b.y1 >= a.y2 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0.25 * least(a.width, b.width) THEN (b.y1 + a.y2) / 2 END) AS u
      FROM s a LEFT JOIN s b ON a.page_id = b.page_id AND a.pos <> b.pos GROUP BY a.page_id, a.pos)
    SELECT s.page_id, s.pos, greatest(x1 - px, coalesce(l, x1 - px)) AS x1, greatest(y1 - py, coalesce(t, y1 - py)) AS y1, least(x2 + px, coalesce(r, x2 + px)) AS x2, least(y2 + py, coalesce(u, y2 + py)) AS y2
    FROM s JOIN n ON s.page_id = n.page_id AND s.pos = n.pos""",
)
def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes with room around them, which ends half-way to a neighbour beside or above."""
    e = elements(spark, sf_dir).where("type = 'text'")
    other = e.select("page_id", *(F.col(c).alias(f"o_{c}") for c in ("pos", *EDGES, "width", "height")))
    o, b = G.box("o_"), G.box()
    beside = F.least(b.y2, o.y2) - F.greatest(b.y1, o.y1) > 0.25 * F.least("height", "o_height")
    above = F.least(b.x2, o.x2) - F.greatest(b.x1, o.x1) > 0.25 * F.least("width", "o_width")
    found = e.join(other, "page_id").where("pos <> o_pos").groupBy("page_id", "pos").agg(
        F.max(F.when((o.x2 <= b.x1) & beside, (o.x2 + b.x1) / 2)).alias("l"), F.min(F.when((o.x1 >= b.x2) & beside, (o.x1 + b.x2) / 2)).alias("r"),
        F.max(F.when((o.y2 <= b.y1) & above, (o.y2 + b.y1) / 2)).alias("t"), F.min(F.when((o.y1 >= b.y2) & above, (o.y1 + b.y2) / 2)).alias("u"),
    )
    px, py = F.least(F.lit(12.0), F.greatest(F.lit(2.0), 0.05 * F.col("width"))), F.greatest(F.lit(2.0), 0.25 * F.col("height"))
    return e.join(found, ["page_id", "pos"], "left").select("page_id", "pos", F.greatest(b.x1 - px, F.coalesce("l", b.x1 - px)).alias("x1"), F.greatest(b.y1 - py, F.coalesce("t", b.y1 - py)).alias("y1"), F.least(b.x2 + px, F.coalesce("r", b.x2 + px)).alias("x2"), F.least(b.y2 + py, F.coalesce("u", b.y2 + py)).alias("y2"))


@query(
    "geo20_group_drag",
    f"""WITH {ELEMENTS}, g AS (SELECT page_id, group_id, greatest(-min(x1), least(150.0, {W} - max(x2))) AS dx, greatest(-min(y1), least(-80.0, {H} - max(y2))) AS dy FROM e WHERE group_id IS NOT NULL GROUP BY page_id, group_id)
    SELECT e.page_id, pos, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2 FROM e JOIN g ON e.page_id = g.page_id AND e.group_id = g.group_id""",
)
def dragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups moved by (150, -80) as far as all their members stay on the canvas."""
    e = elements(spark, sf_dir).where("group_id IS NOT NULL")
    room = e.groupBy("page_id", "group_id").agg(F.greatest(-F.min("x1"), F.least(F.lit(150.0), W - F.max("x2"))).alias("dx"), F.greatest(-F.min("y1"), F.least(F.lit(-80.0), H - F.max("y2"))).alias("dy"))
    return e.join(room, ["page_id", "group_id"]).select("page_id", "pos", *((F.col(c) + F.col("dx" if c[0] == "x" else "dy")).alias(c) for c in EDGES))

"""Queries that fold a page's rows in order: lines, paragraphs, rows of elements, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import folds as K
from ..operators import relations as R
from ..sources.views import ELEMENTS, OCR_LINES, RICH, elements, ocr_lines, rich
from .geometry import H, W
from .registry import add, query
from .relations import A, B

KEY = ["page_id", "pos"]
_ME = "struct_pack(x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2, role := r.role)"
#: Pieces of lines: three of each recognised line, side by side.
_PIECES = "pc AS (SELECT page_id, pos * 3 + k AS pos, x1 + k * (x2 - x1 + 9) / 3 AS x1, y1 + (pos * k) % 5 AS y1, x1 + k * (x2 - x1 + 9) / 3 + (x2 - x1) / 3 AS x2, y2 + (pos * 2 + k) % 4 AS y2, role FROM o, (SELECT unnest([0, 1, 2]) AS k))"


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = (F.col("x2") - F.col("x1") + 9) / 3
    o = ocr_lines(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return o.select("page_id", (F.col("pos") * 3 + F.col("k")).alias("pos"), (F.col("x1") + F.col("k") * wide).alias("x1"), (F.col("y1") + (F.col("pos") * F.col("k")) % 5).alias("y1"), (F.col("x1") + F.col("k") * wide + (F.col("x2") - F.col("x1")) / 3).alias("x2"), (F.col("y2") + (F.col("pos") * 2 + F.col("k")) % 4).alias("y2"), "role")


def folded(ctes: str, source: str, order: str, fits: str, select: str) -> str:
    """A recursion over a page's rows that carries its open blocks; fits tells of a block b and the row r."""
    return f"""WITH RECURSIVE {ctes}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS i FROM {source}),
    g AS (SELECT page_id, i, pos, [{_ME}] AS blocks, CAST(0 AS BIGINT) AS block FROM r WHERE i = 1
      UNION ALL SELECT page_id, i, pos, CASE WHEN at_k IS NULL THEN list_append(blocks, me) ELSE list_transform(blocks, lambda b, k: CASE WHEN k = at_k THEN struct_pack(x1 := least(b.x1, me.x1), y1 := least(b.y1, me.y1), x2 := greatest(b.x2, me.x2), y2 := greatest(b.y2, me.y2), role := b.role) ELSE b END) END, coalesce(at_k - 1, len(blocks))
        FROM (SELECT r.page_id, r.i, r.pos, g.blocks, {_ME} AS me, list_max([k FOR k IN range(greatest(1, len(g.blocks) - 7), len(g.blocks) + 1) IF {fits}]) AS at_k FROM g JOIN r ON g.page_id = r.page_id AND r.i = g.i + 1))
    {select}"""


_B, _HIGH = "g.blocks[k]", "(r.y2 - r.y1)"
_PARAGRAPH = f"({_B}.role = r.role AND r.y1 - {_B}.y2 >= -0.25 * {_HIGH} AND r.y1 - {_B}.y2 <= greatest(10.0, 0.9 * {_HIGH}) AND (least(r.x2, {_B}.x2) - greatest(r.x1, {_B}.x1) > 0.2 * least(r.x2 - r.x1, {_B}.x2 - {_B}.x1) OR abs({_B}.x1 - r.x1) <= greatest(18.0, 1.4 * {_HIGH})))"
_BH = f"({_B}.y2 - {_B}.y1)"
_MOST, _LESS = f"greatest({_BH}, {_HIGH})", f"greatest(1.0, least({_BH}, {_HIGH}))"
_LINE = f"({_B}.role = r.role AND {_MOST} / {_LESS} <= 1.35 AND abs({_B}.y1 + {_BH} / 2 - (r.y1 + {_HIGH} / 2)) <= 0.38 * {_MOST} AND r.x1 - {_B}.x2 >= -0.4 * {_MOST} AND r.x1 - {_B}.x2 <= greatest(10.0, least(72.0, 2.2 * {_MOST})))"
add("win01_same_line", lambda s, d: K.same_lines(pieces(s, d)), folded(f"{OCR_LINES}, {_PIECES}", "pc", "y1, x1, pos", _LINE, "SELECT page_id, pos, CAST(block AS INT) AS block FROM g"))
add("win02_paragraph_merge", lambda s, d: K.merged_lines(ocr_lines(s, d)), folded(OCR_LINES, "o", "pos", _PARAGRAPH, "SELECT page_id, pos, CAST(block AS INT) AS block FROM g"))


@query(
    "win15_text_grouping",
    folded(f"{OCR_LINES}, {_PIECES}", "pc", "y1, x1, pos", _LINE, "SELECT page_id, count(*) AS pieces, count(DISTINCT block) AS lines, count(*) - count(DISTINCT block) AS merged, (SELECT count(*) FROM (SELECT block FROM g h WHERE h.page_id = g.page_id GROUP BY block HAVING count(*) = 1)) AS single FROM g GROUP BY page_id"),
)
def text_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces of a page became lines: merged ones, and those that stayed single."""
    lines = K.same_lines(pieces(spark, sf_dir)).groupBy("page_id", "block").agg(F.count("*").alias("n"))
    return lines.groupBy("page_id").agg(F.sum("n").alias("pieces"), F.count("*").alias("lines"), (F.sum("n") - F.count("*")).alias("merged"), F.count_if(F.col("n") == 1).alias("single"))


def clustered(ctes: str, source: str, key: str, tolerance: float, select: str) -> str:
    """Rows by running medians of their centres; key names what is clustered apart."""
    return f"""WITH RECURSIVE {ctes}, r AS (SELECT *, (y1 + y2) / 2 AS cy, row_number() OVER (PARTITION BY {key} ORDER BY y1, pos) AS i FROM {source}),
    g AS (SELECT {key}, i, pos, [[cy]] AS rows, CAST(0 AS BIGINT) AS row_no FROM r WHERE i = 1
      UNION ALL SELECT {key}, i, pos, CASE WHEN at_k IS NULL THEN list_append(rows, [cy]) ELSE list_transform(rows, lambda x, k: CASE WHEN k = at_k THEN list_append(x, cy) ELSE x END) END, coalesce(at_k - 1, len(rows))
        FROM (SELECT {', '.join(f'r.{k.strip()}' for k in key.split(','))}, r.i, r.pos, r.cy, g.rows, list_min([k FOR k IN range(1, len(g.rows) + 1) IF abs(list_median(g.rows[k]) - r.cy) <= {tolerance}]) AS at_k FROM g JOIN r ON {' AND '.join(f'g.{k.strip()} = r.{k.strip()}' for k in key.split(','))} AND r.i = g.i + 1))
    {select}"""


add("win04_row_clusters", lambda s, d: K.row_clusters(elements(s, d), 18.0), clustered(ELEMENTS, "e", "page_id", 18.0, "SELECT page_id, pos, CAST(row_no AS INT) AS row_no FROM g"))
#: Texts by what they are, so that each kind of a page makes rows of its own.
_KINDS = "kd AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'label' ELSE 'body' END AS kind FROM e WHERE type <> 'line')"
_TOLERANCE = max(8.0, H * 0.025)


def rows_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir).where("type <> 'line'").withColumn("kind", F.when(F.col("pos") % 2 == 0, "label").otherwise("body"))
    apart = e.withColumn("page_id", F.col("page_id") * 2 + (F.col("kind") == "label").cast("int"))
    rows = K.row_clusters(apart, _TOLERANCE).withColumn("page_id", F.expr("page_id div 2"))
    return e.join(rows, KEY)


_ROWS = "SELECT {what} FROM (SELECT kd.*, g.row_no FROM g JOIN kd USING (page_id, kind, pos))"
add(
    "win05_row_snap",
    lambda s, d: rows_by_kind(s, d).withColumns({"mid": F.median("y1").over(Window.partitionBy("page_id", "kind", "row_no")), "n": F.count("*").over(Window.partitionBy("page_id", "kind", "row_no"))}).select(*KEY, F.when(F.col("n") >= 3, G.bounded_move(F.col("y1"), F.col("mid"), F.lit(H * 0.012), F.lit(0.0), H - F.col("height"))).otherwise(F.col("y1")).alias("y")),
    clustered(f"{ELEMENTS}, {_KINDS}", "kd", "page_id, kind", _TOLERANCE, f"SELECT page_id, pos, CASE WHEN count(*) OVER w >= 3 THEN least(greatest(greatest(y1 - {H * 0.012!r}, least(y1 + {H * 0.012!r}, median(y1) OVER w)), 0.0), {H}.0 - height) ELSE y1 END AS y FROM (SELECT kd.*, g.row_no FROM g JOIN kd USING (page_id, kind, pos)) WINDOW w AS (PARTITION BY page_id, kind, row_no)"),
)


@query(
    "win06_even_spacing",
    clustered(f"{ELEMENTS}, {_KINDS}", "kd", "page_id, kind", _TOLERANCE, f"SELECT page_id, pos, CASE WHEN n >= 3 AND kind = 'label' AND i > 0 AND i < n - 1 THEN least(greatest(greatest(x1 - {W * 0.015!r}, least(x1 + {W * 0.015!r}, lo + (hi - lo) / (n - 1) * i - width / 2)), 0.0), {W}.0 - width) ELSE x1 END AS x FROM (SELECT *, row_number() OVER (PARTITION BY page_id, kind, row_no ORDER BY x1 + width / 2, pos) - 1 AS i, count(*) OVER w AS n, min(x1 + width / 2) OVER w AS lo, max(x1 + width / 2) OVER w AS hi FROM (SELECT kd.*, g.row_no FROM g JOIN kd USING (page_id, kind, pos)) WINDOW w AS (PARTITION BY page_id, kind, row_no))"),
)
def even_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In rows of three labels and more those inside move a little towards even steps from the first to the last."""
    w = Window.partitionBy("page_id", "kind", "row_no")
    cx = F.col("x1") + F.col("width") / 2
    r = rows_by_kind(spark, sf_dir).withColumns({"i": F.row_number().over(w.orderBy(cx, "pos")) - 1, "n": F.count("*").over(w), "lo": F.min(cx).over(w), "hi": F.max(cx).over(w)})
    inside = (F.col("n") >= 3) & (F.col("kind") == "label") & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    even = F.col("lo") + (F.col("hi") - F.col("lo")) / (F.col("n") - 1) * F.col("i") - F.col("width") / 2
    return r.select(*KEY, F.when(inside, G.bounded_move(F.col("x1"), even, F.lit(W * 0.015), F.lit(0.0), W - F.col("width"))).otherwise(F.col("x1")).alias("x"))


def layers(x: DataFrame) -> DataFrame:
    """Four passes, each on what the one before left: visuals above containers, planned visuals above residual ones, supports above visuals, texts above all."""
    shown = x.where("NOT suppressed AND owned_by IS NULL").withColumn("z", F.col("z_index"))
    kind = F.when(F.col("type") == "text", "text").when(F.col("type") == "image", "visual").when(F.col("type").isin("rectangle", "ellipse"), "container").otherwise("other")
    shown = shown.withColumns({"kind": kind, "planned": F.col("strategy").isin("hybrid", "editable"), "residual": F.col("art"), "support": F.col("strategy") == "native_shape"})

    def raised(now: DataFrame, who: str, over: str, at_least: bool, default: int | None) -> DataFrame:
        p = R.pairs(now.where(who), now.where(over), G.intersects(A(), B()) & (F.col("a_pos") != F.col("b_pos"))).groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.max("b_z").alias("top"))
        top = F.coalesce(F.col("top"), F.lit(default)) + 1
        z = F.when(F.expr(who), F.coalesce(F.greatest(F.col("z"), top) if at_least else top, F.col("z"))).otherwise(F.col("z"))
        return now.join(p, KEY, "left").withColumn("z", z).drop("top")

    now = raised(shown, "kind = 'visual'", "kind = 'container' AND NOT support", False, 0)
    now = raised(now, "kind = 'visual' AND planned", "kind = 'visual' AND residual", True, 0)
    now = raised(now, "kind = 'container' AND support", "kind = 'visual'", True, 0)
    return raised(now, "kind = 'text'", "kind IN ('container', 'visual')", True, None).select(*KEY, "z")


def _pass(k: int, who: str, over: str, z: str) -> str:
    hit = "a.page_id = b.page_id AND a.pos <> b.pos AND greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) > 0"
    return f"t{k} AS (SELECT a.page_id, a.pos, max(b.z) AS top FROM z{k - 1} a JOIN z{k - 1} b ON {hit} WHERE {' AND '.join('a.' + c for c in who)} AND {over} GROUP BY a.page_id, a.pos), z{k} AS (SELECT * EXCLUDE (z, top), CASE WHEN {' AND '.join(who)} THEN {z} ELSE z END AS z FROM z{k - 1} LEFT JOIN t{k} USING (page_id, pos))"


add(
    "win11_layered_z",
    lambda s, d: layers(rich(s, d)),
    f"""WITH {ELEMENTS}, {RICH}, z0 AS (SELECT page_id, pos, x1, y1, x2, y2, z_index AS z, CASE WHEN type = 'text' THEN 'text' WHEN type = 'image' THEN 'visual' WHEN type IN ('rectangle', 'ellipse') THEN 'container' ELSE 'other' END AS kind, strategy IN ('hybrid', 'editable') AS planned, art AS residual, strategy = 'native_shape' AS support FROM x WHERE NOT suppressed AND owned_by IS NULL),
    {_pass(1, ["kind = 'visual'"], "b.kind = 'container' AND NOT b.support", "coalesce(top, 0) + 1")}, {_pass(2, ["kind = 'visual'", "planned"], "b.kind = 'visual' AND b.residual", "greatest(z, coalesce(top, 0) + 1)")},
    {_pass(3, ["kind = 'container'", "support"], "b.kind = 'visual'", "greatest(z, coalesce(top, 0) + 1)")}, {_pass(4, ["kind = 'text'"], "b.kind IN ('container', 'visual')", "coalesce(greatest(z, top + 1), z)")} SELECT page_id, pos, z FROM z4""",
)

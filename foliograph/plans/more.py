"""Queries of further joins, payload coercions, folds and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import folds as K
from ..operators import relations as R
from ..sources.views import ELEMENTS, OCR_LINES, elements, ocr_lines
from .registry import add, query
from .relations import IMAGES, TEXTS, A, B
from .scalars import case


@query(
    "geo18_clip_preserved",
    f"""WITH {ELEMENTS}, t AS (SELECT * FROM e WHERE type = 'text'), i AS (SELECT * FROM e WHERE type = 'image'),
    n AS (SELECT t.page_id, t.pos, min(CASE WHEN i.x1 >= t.x2 AND least(t.y2, i.y2) > greatest(t.y1, i.y1) THEN i.x1 END) AS r, max(CASE WHEN i.x2 <= t.x1 AND least(t.y2, i.y2) > greatest(t.y1, i.y1) THEN i.x2 END) AS l FROM t LEFT JOIN i ON t.page_id = i.page_id GROUP BY t.page_id, t.pos)
    SELECT t.page_id, t.pos, greatest(t.x1 - 20, coalesce(l, t.x1 - 20)) AS x1, least(t.x2 + 20, coalesce(r, t.x2 + 20)) AS x2 FROM t JOIN n ON t.page_id = n.page_id AND t.pos = n.pos""",
)
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes grown by 20 pixels to each side, but not into an image beside them."""
    e = elements(spark, sf_dir)
    p = R.pairs(e.where(TEXTS), e.where(IMAGES), how="left")
    a, b = A(), B()
    level = F.least(a.y2, b.y2) > F.greatest(a.y1, b.y1)
    cut = p.groupBy("page_id", "a_pos", "a_x1", "a_x2").agg(F.min(F.when((b.x1 >= a.x2) & level, b.x1)).alias("r"), F.max(F.when((b.x2 <= a.x1) & level, b.x2)).alias("l"))
    return cut.select("page_id", F.col("a_pos").alias("pos"), F.greatest(F.col("a_x1") - 20, F.coalesce("l", F.col("a_x1") - 20)).alias("x1"), F.least(F.col("a_x2") + 20, F.coalesce("r", F.col("a_x2") + 20)).alias("x2"))


# filters, projections
add("prj15_text_style", lambda s, d: ocr_lines(s, d).select("page_id", "pos", S.font_class(F.col("text"), F.col("role")).alias("kind"), S.lookup(F.col("role"), {"main_title": 700}, F.lit(400)).alias("weight"), S.lookup(F.col("role"), S.LINE_SPACINGS, F.lit(1.0)).alias("spacing")), f"WITH {OCR_LINES} SELECT page_id, pos, CASE WHEN regexp_matches(text, '^[0-9\\s.,%+\\-/:]+$') THEN 'monospace' WHEN role = 'main_title' THEN 'display' WHEN role = 'caption' THEN 'serif' ELSE 'sans' END AS kind, CASE role WHEN 'main_title' THEN 700 ELSE 400 END AS weight, {case('role', S.LINE_SPACINGS, '1.0')} AS spacing FROM o")

# joins



# aggregates
add("agg06_movable_assets", lambda s, d: elements(s, d).where("type <> 'text'").groupBy("page_id").agg(F.count_if(F.col("visible")).alias("assets"), F.count_if(~F.col("visible")).alias("residual"), (F.sum(F.when(F.col("visible"), F.col("width") * F.col("height")).otherwise(0.0)) / F.sum(F.col("width") * F.col("height"))).alias("coverage")), f"WITH {ELEMENTS} SELECT page_id, count_if(visible) AS assets, count_if(NOT visible) AS residual, sum(CASE WHEN visible THEN width * height ELSE 0.0 END) / sum(width * height) AS coverage FROM e WHERE type <> 'text' GROUP BY page_id")

# folds
add("win08_duplicate_owner", lambda s, d: K.winners(elements(s, d).where(TEXTS), "text"), f"WITH {ELEMENTS} SELECT page_id, text, arg_min(pos, struct_pack(c := -confidence, p := pos)) AS pos FROM e WHERE type = 'text' GROUP BY page_id, text")
add("itr01_component_grouping", lambda s, d: K.grouped_by_gap(elements(s, d).where(IMAGES), 12.0), f"""WITH RECURSIVE {ELEMENTS}, i AS (SELECT * FROM e WHERE type = 'image'),
 n AS (SELECT a.page_id, a.pos AS a, b.pos AS b FROM i a JOIN i b ON a.page_id = b.page_id AND greatest(a.x1 - b.x2, b.x1 - a.x2, a.y1 - b.y2, b.y1 - a.y2, 0.0) <= 12.0),
 r AS (SELECT page_id, a AS root, b AS pos FROM n UNION SELECT r.page_id, r.root, n.b FROM r JOIN n ON n.page_id = r.page_id AND n.a = r.pos) SELECT page_id, pos, min(root) AS grp FROM r GROUP BY page_id, pos""")

# versions


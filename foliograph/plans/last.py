"""Queries of issues from all their sources, of refined texts, of elements as a model says them, and of seams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import relations as R
from ..sources.views import ELEMENTS, PIXELS, RICH, pixels, rich, table
from .geometry import H, W
from .inputs import MODULE_ALIAS, of
from .loops import AUDITS, audits
from .registry import add, query
from .relations import A, B
from .rules import _ISSUES, issues_of

KEY = ["page_id", "pos"]


@query(
    "sta11_issue_collection",
    f"""WITH {ELEMENTS}, {RICH}, {AUDITS}, {_ISSUES}, d AS (SELECT b.page_id, b.pos FROM x a JOIN x b ON a.page_id = b.page_id AND a.pos < b.pos AND a.type = b.type AND a.text IS NOT DISTINCT FROM b.text
      AND greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / greatest(least(a.width * a.height, b.width * b.height), 1.0) > 0.7)
    SELECT page_id, pos, 'duplicateElement' AS problem FROM d UNION SELECT page_id, pos, 'wrongBBox' FROM x WHERE x2 > {W} OR y2 > {H} UNION SELECT page_id, pos, 'missingEditableText' FROM x WHERE type = 'text' AND suppressed
    UNION SELECT page_id, pos, problem FROM is0 WHERE reason <> 'none' UNION SELECT page_id, -1, 'missingVisualObject' FROM au WHERE missing_after - missing_before > 96 UNION SELECT page_id, pos, 'blankVisualOwner' FROM x WHERE type = 'image' AND visible AND element_id * 13 % 17 = 0""",
)
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What six sources say of a page, each issue once: geometry twice, lost texts, the critic, the audit of pixels, the inventory of files."""
    x = rich(spark, sf_dir)
    named = lambda df, problem: df.select("page_id", F.col("pos").cast("int").alias("pos"), F.lit(problem).alias("problem"))
    twins = R.pairs(x, on=(F.col("a_type") == F.col("b_type")) & F.col("a_text").eqNullSafe(F.col("b_text")) & (G.overlap_min(A(), B()) > 0.7)).select("page_id", F.col("b_pos").alias("pos"))
    parts = [
        named(twins, "duplicateElement"), named(x.where((F.col("x2") > W) | (F.col("y2") > H)), "wrongBBox"), named(x.where("type = 'text' AND suppressed"), "missingEditableText"),
        issues_of(x).where("reason <> 'none'").select(*KEY, "problem"), named(audits(spark, sf_dir).where("missing_after - missing_before > 96").withColumn("pos", F.lit(-1)), "missingVisualObject"), named(x.where("type = 'image' AND visible AND element_id * 13 % 17 = 0"), "blankVisualOwner"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


# How much a text of a role may grow and move, and its lines' spacing.
_GROW, _MOVE, _SPACE = {"title": 1.15, "subtitle": 1.12, "card_title": 1.1}, {"title": 0.03, "subtitle": 0.025, "card_title": 0.02}, {"title": 1.05, "subtitle": 1.1, "card_title": 1.08}


def num(values: dict, default: float) -> str:
    return "CASE role " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in values.items()) + f" ELSE {default!r}::DOUBLE END"


def refined(x: DataFrame) -> DataFrame:
    """A text's box, size and spacing by its role's policy, and what of it changed."""
    pick = lambda values, default: F.coalesce(*(F.when(F.col("role") == k, F.lit(v)) for k, v in values.items()), F.lit(default))
    wide = F.least(F.col("width") * pick(_GROW, 1.06), W - F.col("x1"))
    x1 = G.bounded_move(F.col("x1"), F.col("x1") - (wide - F.col("width")) / 2, pick(_MOVE, 0.015) * W, F.lit(0.0), W - wide)
    size = F.col("height") * F.least(F.greatest(F.col("width") / 100, F.lit(0.85)), F.lit(1.15))
    t = x.where("type = 'text'").withColumns({"w": wide, "z": size, "spacing": pick(_SPACE, 1.2)}).withColumn("x", x1)
    return t.select(*KEY, F.round("x", 6).alias("x"), F.round("w", 6).alias("w"), F.round("z", 6).alias("size"), "spacing", (F.abs(F.col("x") - F.col("x1")) > 0.5).cast("int").alias("moved"), (F.abs(F.col("z") - F.col("height")) > 0.5).cast("int").alias("resized"))


add(
    "prj16_refine_text",
    lambda s, d: refined(rich(s, d)),
    f"""WITH {ELEMENTS}, {RICH}, t AS (SELECT *, least(width * {num(_GROW, 1.06)}, {W}.0 - x1) AS w, height * least(greatest(width / 100, 0.85::DOUBLE), 1.15::DOUBLE) AS z, {num(_SPACE, 1.2)} AS spacing, {num(_MOVE, 0.015)} * {W} AS most FROM x WHERE type = 'text'),
    u AS (SELECT *, least(greatest(greatest(x1 - most, least(x1 + most, x1 - (w - width) / 2)), 0.0), {W}.0 - w) AS nx FROM t) SELECT page_id, pos, round(nx, 6) AS x, round(w, 6) AS w, round(z, 6) AS size, spacing, CAST(abs(nx - x1) > 0.5 AS INT) AS moved, CAST(abs(z - height) > 0.5 AS INT) AS resized FROM u""",
)
_SAID = """'{"id":' || CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE '"e' || event_id || '"' END || ',"confidence":' || CASE event_id % 4 WHEN 0 THEN '"high"' WHEN 1 THEN '"85%"' WHEN 2 THEN '0.25' ELSE '"none"' END || ',"fontWeight":' || CASE event_id % 3 WHEN 0 THEN '"bold"' WHEN 1 THEN '"650"' ELSE '"odd"' END || ',"alignment":' || CASE event_id % 5 WHEN 0 THEN '"Centre"' WHEN 1 THEN '"RIGHT"' ELSE '"left"' END || ',"reconstructionStrategy":' || CASE event_id % 3 WHEN 0 THEN '"hybrid"' WHEN 1 THEN '"text"' ELSE '"cutout_image"' END || ',"doNotVectorize":' || CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' WHEN 2 THEN '"No"' ELSE '0' END || '}'"""


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element as a model says it: its id as text, then confidence, weight, alignment, strategy and flag in their own terms."""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_SAID.replace("VARCHAR", "STRING")).alias("raw"))
    at = lambda p: F.get_json_object("raw", f"$.{p}")
    return raw.select("event_id", at("id").alias("id"), S.probability(at("confidence"), 0.5).alias("confidence"), F.coalesce(S.font_weight(at("fontWeight")), F.lit(400)).alias("weight"), S.alignment(at("alignment")).alias("alignment"), S.lookup(at("reconstructionStrategy"), MODULE_ALIAS, at("reconstructionStrategy")).alias("strategy"), F.lower(at("doNotVectorize")).isin("true", "yes", "1").alias("whole"))


add(
    "sca38_scene_element",
    spoken,
    f"""WITH r AS (SELECT event_id, {_SAID} AS raw FROM events), j AS (SELECT event_id, json_extract_string(raw, '$.id') AS id, json_extract_string(raw, '$.confidence') AS c, json_extract_string(raw, '$.fontWeight') AS w, lower(json_extract_string(raw, '$.alignment')) AS a, json_extract_string(raw, '$.reconstructionStrategy') AS s, lower(json_extract_string(raw, '$.doNotVectorize')) AS v FROM r)
    SELECT event_id, id, CASE c WHEN 'high' THEN 0.9 WHEN '85%' THEN 0.85 WHEN '0.25' THEN 0.25 ELSE 0.5 END AS confidence, CASE w WHEN 'bold' THEN 700 WHEN '650' THEN 600 ELSE 400 END AS weight, CASE a WHEN 'centre' THEN 'center' ELSE a END AS alignment, {of(MODULE_ALIAS, 's', 's')} AS strategy, v IN ('true', 'yes', '1') AS whole FROM j""",
)


def seams(p: DataFrame) -> DataFrame:
    """Runs of sparse columns or rows inside a tile; the best is long, empty and near the middle."""
    both = p.select("page_id", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("px").alias("k")), F.struct(F.lit("y").alias("axis"), F.col("py").alias("k")))).alias("a"), "v").select("page_id", "a.*", "v")
    lines = both.groupBy("page_id", "axis", "k").agg(F.count_if(F.col("v") >= 136).alias("n")).where("n <= 2 AND k BETWEEN 1 AND 6")
    w = Window.partitionBy("page_id", "axis").orderBy("k")
    runs = lines.withColumn("island", F.col("k") - F.row_number().over(w)).groupBy("page_id", "axis", "island").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.sum("n").alias("n"), F.count("*").alias("size"))
    score = F.round(F.col("size") * 8 - F.col("n") - F.abs((F.col("a") + F.col("b")) / 2 - 3.5), 6)
    best = runs.groupBy("page_id").agg(F.max(F.struct(score.alias("score"), (-F.col("a")).alias("first"), "axis", "b")).alias("m"))
    return best.select("page_id", "m.axis", (-F.col("m.first")).alias("a"), "m.b", "m.score")


add(
    "win14_seam",
    lambda s, d: seams(pixels(s, d)),
    f"""WITH {PIXELS}, l AS (SELECT page_id, 'x' AS axis, px AS k, count_if(v >= 136) AS n FROM px GROUP BY page_id, px UNION ALL SELECT page_id, 'y', py, count_if(v >= 136) FROM px GROUP BY page_id, py), q AS (SELECT *, k - row_number() OVER (PARTITION BY page_id, axis ORDER BY k) AS island FROM l WHERE n <= 2 AND k BETWEEN 1 AND 6),
    r AS (SELECT page_id, axis, min(k) AS a, max(k) AS b, count(*) * 8 - sum(n) - abs((min(k) + max(k)) / 2 - 3.5) AS score FROM q GROUP BY page_id, axis, island), t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, a, axis DESC, b DESC) AS nth FROM r) SELECT page_id, axis, a, b, round(score, 6) AS score FROM t WHERE nth = 1""",
)

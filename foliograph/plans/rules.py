"""Queries of the rules that need an element's role, strategy and measures: filters, modules, scores, issues."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import relations as R
from ..sources.views import ELEMENTS, RICH, rich
from .geometry import H, W
from .registry import add, query
from .relations import A, B

#: The fixed values of the rules: strategies by what they were called before, and those that a module may have.
ALIAS = {"editable": "editable_text", "whole_image": "cutout_image", "movable_image": "cutout_image", "hybrid": "mixed_component"}
STRATEGIES = ("editable_text", "native_shape", "cutout_image", "mixed_component", "background", "ignore")
KINDS = {"image": "image", "ellipse": "figure", "rectangle": "chart", "line": "table"}
SURE = {"image": 0.55, "figure": 0.60, "chart": 0.60, "table": 0.65}
FLOW = "flow|process|workflow|流程|过程"
PRIORITY = {"ghosting": 0, "largeVisualLoss": 1, "duplicateText": 2, "wrongOwnership": 2, "visualContentMismatch": 3, "wrongBBox": 4, "textOverlap": 5, "missingEditableText": 6, "brokenChartOrModule": 7, "backgroundResidual": 10}
OVERRIDES = ("dark_residual_over_pale_source", "pale_support_overwritten", "colored_residual_washed_out")
KEY = ["page_id", "pos"]


def said(values: dict, of: str, default: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {of} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {default} END"


def looked_up(values: dict, of: Column, default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for k, v in values.items():
        out = out.when(of == k, F.lit(v))
    return out.otherwise(default)


def rule(name: str, run, sql: str) -> None:
    add(name, lambda spark, sf_dir: run(rich(spark, sf_dir)), f"WITH {ELEMENTS}, {RICH} {sql}")


def first(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n)


# filters
rule("fil03_ordinary_text", lambda x: x.where((F.col("type") == "text") & ~F.col("role").isin("logo", "decorative_text") & ~F.col("art")).select(*KEY), "SELECT page_id, pos FROM x WHERE type = 'text' AND role NOT IN ('logo', 'decorative_text') AND NOT art")


def admissible(x: DataFrame) -> DataFrame:
    """Modules that a plan may have: of a scene of four pages the first hundred, sure enough, with a known strategy and a box that isn't too large for it."""
    module = first(x.where("type <> 'text'").withColumn("scene", F.expr("page_id div 4")), ["scene"], ["page_id", "pos"], 100)
    strategy = looked_up(ALIAS, F.col("strategy"), F.col("strategy"))
    most = F.when(strategy == "background", 1.0).when(F.col("strategy") == "whole_image", 0.9).otherwise(0.8)
    share = F.greatest(F.least("x2", F.lit(float(W))) - F.col("x1"), F.lit(0.0)) * F.greatest(F.least("y2", F.lit(float(H))) - F.col("y1"), F.lit(0.0)) / (W * H)
    return module.where((F.col("confidence") >= 0.65) & strategy.isin(*STRATEGIES) & (share > 0) & (share <= most)).select(*KEY, strategy.alias("strategy"))


rule(
    "fil05_module_admissible",
    admissible,
    f""", m AS (SELECT *, row_number() OVER (PARTITION BY page_id // 4 ORDER BY page_id, pos) AS nth, {said(ALIAS, 'strategy', 'strategy')} AS s,
      greatest(least(x2, {W}.0) - x1, 0.0) * greatest(least(y2, {H}.0) - y1, 0.0) / {W * H} AS share FROM x WHERE type <> 'text')
    SELECT page_id, pos, s AS strategy FROM m WHERE nth <= 100 AND confidence >= 0.65 AND s IN {STRATEGIES!r} AND share > 0
      AND share <= CASE WHEN s = 'background' THEN 1.0 WHEN strategy = 'whole_image' THEN 0.9 ELSE 0.8 END""",
)


@query(
    "fil06_region_admissible",
    f"""WITH {ELEMENTS}, {RICH}, g AS (SELECT page_id, pos, {said(KINDS, 'type', 'NULL')} AS kind, confidence, x1, y1, least(x2, {W}.0) AS x2, least(y2, {H}.0) AS y2 FROM x WHERE type <> 'text'),
    f AS (SELECT * FROM g WHERE confidence >= {said(SURE, 'kind', '9.0')} AND least(x2 - x1, y2 - y1) >= CASE WHEN kind = 'image' THEN 24 ELSE 50 END
      AND (x2 - x1) * (y2 - y1) >= CASE WHEN kind = 'image' THEN 400.0 ELSE {W * H * 0.008!r} END AND y2 <= {H * 0.99!r}),
    m AS (SELECT page_id, pos AS module, x1 AS mx1, x2 AS mx2, y1 AS my1 FROM x WHERE type = 'rectangle'),
    n AS (SELECT f.page_id, module, f.pos, row_number() OVER (PARTITION BY f.page_id, module ORDER BY f.pos) AS nth FROM f JOIN m ON f.page_id = m.page_id AND (f.x1 + f.x2) / 2 BETWEEN mx1 AND mx2 AND f.y1 >= my1)
    SELECT page_id, module, pos FROM n WHERE nth <= 12""",
)
def region_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected regions by the module whose columns hold their middle, the first twelve of each."""
    x = rich(spark, sf_dir)
    kind = looked_up(KINDS, F.col("type"), F.lit(None).cast("string"))
    box = x.where("type <> 'text'").select(*KEY, kind.alias("kind"), "confidence", "x1", "y1", F.least("x2", F.lit(float(W))).alias("x2"), F.least("y2", F.lit(float(H))).alias("y2"))
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    large = F.least(wide, high) >= F.when(F.col("kind") == "image", 24).otherwise(50)
    kept = box.where((F.col("confidence") >= looked_up(SURE, F.col("kind"), F.lit(9.0))) & large & (wide * high >= F.when(F.col("kind") == "image", 400.0).otherwise(W * H * 0.008)) & (F.col("y2") <= H * 0.99))
    module = x.where("type = 'rectangle'").select("page_id", F.col("pos").alias("module"), F.col("x1").alias("mx1"), F.col("x2").alias("mx2"), F.col("y1").alias("my1"))
    met = kept.join(module, "page_id").where(((F.col("x1") + F.col("x2")) / 2).between(F.col("mx1"), F.col("mx2")) & (F.col("y1") >= F.col("my1")))
    return first(met, ["page_id", "module"], ["pos"], 12).select("page_id", "module", "pos")


_CAPTION = "t.y1 > r.y1 + r.h * 0.55 AND t.y1 < r.y1 + r.h AND greatest(least(r.x2, t.x2) - greatest(r.x1, t.x1), 0) > (r.x2 - r.x1) * 0.65"


@query(
    "fil07_unplanned_proposal",
    f"""WITH RECURSIVE {ELEMENTS}, {RICH}, g AS (SELECT page_id, pos, {said(KINDS, 'type', 'NULL')} AS kind, confidence, x1, x2, y1, height AS h FROM x WHERE type <> 'text'),
    r0 AS (SELECT * FROM g WHERE confidence >= CASE WHEN kind = 'image' THEN 0.55 ELSE 0.60 END),
    t AS (SELECT page_id, x1, x2, y1, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM x WHERE type = 'text' AND confidence >= 0.5),
    r AS (SELECT page_id, pos, x1, x2, y1, h, CAST(0 AS BIGINT) AS nth FROM r0
      UNION ALL SELECT r.page_id, r.pos, r.x1, r.x2, r.y1, CASE WHEN {_CAPTION} THEN least(r.h, t.y1 - r.y1 - 2) ELSE r.h END, t.nth FROM r JOIN t ON r.page_id = t.page_id AND t.nth = r.nth + 1),
    z AS (SELECT page_id, pos, x1, x2, arg_max(h, nth) AS h FROM r GROUP BY page_id, pos, x1, x2),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM z WHERE x2 - x1 >= 24 AND h >= 24 AND (x2 - x1) * h >= {W * H * 0.00025!r} AND (x2 - x1) * h <= {W * H * 0.35!r})
    SELECT page_id, pos, h FROM k WHERE nth <= 32""",
)
def unplanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected visuals, cut off above captions: each sure text in turn that begins in the lower part and covers most of the width; the first 32 of a page."""
    x = rich(spark, sf_dir)
    texts = x.where("type = 'text' AND confidence >= 0.5").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x1", "x2", "y1"))).alias("texts"))
    r = x.where("type <> 'text'").where(F.col("confidence") >= F.when(F.col("type") == "image", 0.55).otherwise(0.60)).join(texts, "page_id", "left")

    def trimmed(h: Column, t: Column) -> Column:
        over = F.greatest(F.least(F.col("x2"), t["x2"]) - F.greatest(F.col("x1"), t["x1"]), F.lit(0.0)) > F.col("width") * 0.65
        return F.when((t["y1"] > F.col("y1") + h * 0.55) & (t["y1"] < F.col("y1") + h) & over, F.least(h, t["y1"] - F.col("y1") - 2)).otherwise(h)

    h = F.aggregate(F.coalesce("texts", F.array().cast("array<struct<pos:int,x1:double,x2:double,y1:double>>")), F.col("height"), trimmed)
    kept = r.select(*KEY, "width", h.alias("h")).where((F.col("width") >= 24) & (F.col("h") >= 24) & (F.col("width") * F.col("h")).between(W * H * 0.00025, W * H * 0.35))
    return first(kept, ["page_id"], ["pos"], 32).select(*KEY, "h")


@query(
    "fil08_segment_proposal",
    f"""WITH {ELEMENTS}, {RICH}, o AS (SELECT s.page_id, s.pos, sum(greatest(least(s.x2, t.x2) - greatest(s.x1, t.x1), 0) * greatest(least(s.y2, t.y2) - greatest(s.y1, t.y1), 0)) AS hidden
      FROM x s JOIN x t ON s.page_id = t.page_id AND s.type <> 'text' AND t.type = 'text' GROUP BY s.page_id, s.pos),
    k AS (SELECT x.page_id, x.pos, row_number() OVER (PARTITION BY x.page_id ORDER BY x.pos) AS nth FROM x LEFT JOIN o USING (page_id, pos) WHERE type <> 'text' AND width * height / {W * H} BETWEEN 0.0003 AND 0.30
      AND width >= 20 AND height >= 20 AND coalesce(hidden, 0) / greatest(width * height, 1.0) <= 0.12 AND fill BETWEEN 0.15 AND 0.98)
    SELECT page_id, pos FROM k WHERE nth <= 24""",
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a fair size and fill that texts hardly cover, the first 24 of a page."""
    x = rich(spark, sf_dir)
    hidden = R.pairs(x.where("type <> 'text'"), x.where("type = 'text'"), G.intersects(A(), B())).groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.sum(G.intersection(A(), B())).alias("hidden"))
    size = F.col("width") * F.col("height")
    fair = (size / (W * H)).between(0.0003, 0.30) & (F.col("width") >= 20) & (F.col("height") >= 20) & F.col("fill").between(0.15, 0.98)
    kept = x.where("type <> 'text'").join(hidden, KEY, "left").where(fair & (F.coalesce("hidden", F.lit(0.0)) / F.greatest(size, F.lit(1.0)) <= 0.12))
    return first(kept, ["page_id"], ["pos"], 24).select(*KEY)


rule("fil10_flow_module", lambda x: x.where(F.lower("role").rlike(FLOW)).select(*KEY), f"SELECT page_id, pos FROM x WHERE regexp_matches(lower(role), '{FLOW}')")


@query(
    "fil11_flow_needs_image",
    f"""WITH {ELEMENTS}, {RICH}, m AS (SELECT page_id, pos, x1 - 150 AS x1, y1 - 100 AS y1, x2 + 150 AS x2, y2 + 100 AS y2 FROM x WHERE regexp_matches(role, '{FLOW}')),
    s AS (SELECT m.page_id, m.pos, count(*) AS n, bool_or(x.confidence < 0.85 OR complexity >= 0.35) AS odd FROM m JOIN x ON m.page_id = x.page_id AND x.type IN ('rectangle', 'ellipse', 'line')
      AND greatest(least(m.x2, x.x2) - greatest(m.x1, x.x1), 0) * greatest(least(m.y2, x.y2) - greatest(m.y1, x.y1), 0) / greatest(x.width * x.height, 1.0) >= 0.75 GROUP BY m.page_id, m.pos)
    SELECT m.page_id, m.pos, coalesce(odd, true) AS needs FROM m LEFT JOIN s USING (page_id, pos)""",
)
def flow_needs_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow module becomes an image if no shape lies in it, or one that does is unsure or complex."""
    x = rich(spark, sf_dir)
    m = x.where(F.col("role").rlike(FLOW)).withColumns({"x1": F.col("x1") - 150, "y1": F.col("y1") - 100, "x2": F.col("x2") + 150, "y2": F.col("y2") + 100})
    p = R.pairs(m, x.where("type IN ('rectangle', 'ellipse', 'line')").withColumn("odd", (F.col("confidence") < 0.85) | (F.col("complexity") >= 0.35)), G.coverage(B(), A()) >= 0.75)
    odd = p.groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.bool_or("b_odd").alias("odd"))
    return m.join(odd, KEY, "left").select(*KEY, F.coalesce("odd", F.lit(True)).alias("needs"))


rule(
    "fil13_small_solid",
    lambda x: x.where((F.col("width") >= 3) & (F.col("height") >= 3) & (F.floor(F.col("fill") * F.col("width") * F.col("height")) >= 9) & (F.col("fill") >= 0.75) & (F.col("saturation") >= 45) & (F.col("delta") >= 40) & (F.col("alike") >= 0.8)).select(*KEY),
    "SELECT page_id, pos FROM x WHERE width >= 3 AND height >= 3 AND floor(fill * width * height) >= 9 AND fill >= 0.75 AND saturation >= 45 AND delta >= 40 AND alike >= 0.8",
)
rule(
    "fil14_opaque_icon",
    lambda x: x.where(F.lower("role").rlike("icon|badge|emblem|decorative") & (F.col("width") >= 12) & (F.col("height") >= 12) & (F.col("saturation") % 25 <= 12) & (1 - F.col("alike") > 0.15)).select(*KEY),
    "SELECT page_id, pos FROM x WHERE regexp_matches(lower(role), 'icon|badge|emblem|decorative') AND width >= 12 AND height >= 12 AND saturation % 25 <= 12 AND 1 - alike > 0.15",
)

# what a page's checks measured: shares, and counts
_MEASURES = {
    "visual": "round(avg(confidence), 6)",
    "coverage": "CAST(sum(CASE WHEN type = 'text' AND visible THEN 1 ELSE 0 END) AS DOUBLE) / greatest(sum(CASE WHEN type = 'text' THEN 1 ELSE 0 END), 1)",
    "movable": "CAST(sum(CASE WHEN type = 'image' AND visible THEN 1 ELSE 0 END) AS DOUBLE) / greatest(sum(CASE WHEN type = 'image' THEN 1 ELSE 0 END), 1)",
    "ghosts": "sum(CASE WHEN type = 'text' AND suppressed THEN 1 ELSE 0 END)",
    "residuals": "sum(CASE WHEN type = 'line' AND suppressed THEN 1 ELSE 0 END)",
    "pending": "sum(CASE WHEN type = 'image' AND complexity >= 0.9 THEN 1 ELSE 0 END)",
    "mismatches": "sum(CASE WHEN type = 'text' AND alike < 0.05 THEN 1 ELSE 0 END)",
    "twins": "sum(CASE WHEN role = 'badge' AND near_twin THEN 1 ELSE 0 END)",
}
_MEASURED = "v AS (SELECT page_id, " + ", ".join(f"{s} AS {n}" for n, s in _MEASURES.items()) + " FROM x GROUP BY page_id)"


def measured(x: DataFrame) -> DataFrame:
    return x.groupBy("page_id").agg(*(F.expr(s).alias(n) for n, s in _MEASURES.items()))


rule(
    "fil16_quality_gates",
    lambda x: measured(x).select("page_id", F.array_join(F.array_compact(F.array(F.when(F.col("coverage") < 0.95, "coverage"), F.when(F.col("ghosts") > 0, "ghosting"), F.when(F.col("mismatches") > 0, "fidelity"), F.when((F.col("movable") < 0.85) | (F.col("residuals") > 0) | (F.col("pending") > 0) | (F.col("twins") > 0), "structure"), F.when(F.col("visual") < 0.85, "visual"))), ",").alias("gates")),
    f", {_MEASURED} SELECT page_id, concat_ws(',', CASE WHEN coverage < 0.95 THEN 'coverage' END, CASE WHEN ghosts > 0 THEN 'ghosting' END, CASE WHEN mismatches > 0 THEN 'fidelity' END, CASE WHEN movable < 0.85 OR residuals > 0 OR pending > 0 OR twins > 0 THEN 'structure' END, CASE WHEN visual < 0.85 THEN 'visual' END) AS gates FROM v",
)
_unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
rule(
    "agg10_enriched",
    lambda x: measured(x).select("page_id", F.round(_unit(0.65 * F.col("visual") + 0.21 * _unit(F.col("coverage")) + 0.14 * _unit(F.col("movable")) - F.least(F.lit(0.35), F.col("ghosts") * 0.08 + F.col("residuals") * 0.08 + F.col("pending") * 0.05)) + 1e-9, 4).alias("overall")),
    f", {_MEASURED} SELECT page_id, round(greatest(0.0, least(1.0, 0.65::DOUBLE * visual + 0.21::DOUBLE * greatest(0.0, least(1.0, coverage)) + 0.14::DOUBLE * greatest(0.0, least(1.0, movable)) - least(0.35::DOUBLE, ghosts * 0.08::DOUBLE + residuals * 0.08::DOUBLE + pending * 0.05::DOUBLE))) + 1e-9, 4) AS overall FROM v",
)

# structure: where texts stand, how far images are from their own shape, how far boxes keep to the page
_IN = f"(greatest(least(x2, {W}.0) - greatest(x1, 0.0), 0.0) * greatest(least(y2, {H}.0) - greatest(y1, 0.0), 0.0) / greatest(width * height, 1.0))"
_ASPECT = "greatest(0.0, 1.0 - abs(ln(width / height) - ln(intrinsic)))"


def structure(x: DataFrame) -> DataFrame:
    same = x.where("type IN ('text', 'image') AND visible").withColumn("same", F.when(F.col("type") == "text", F.lower(F.trim("text"))).otherwise(F.col("group_id")))
    twins = R.pairs(same, on=(F.col("a_type") == F.col("b_type")) & (F.col("a_same") == F.col("b_same")) & (G.overlap_min(A(), B()) > 0.85)).groupBy("page_id").agg(F.count("*").alias("twins"))
    parts = x.groupBy("page_id").agg(
        F.avg(F.when(F.col("type") == "text", F.expr(_IN))).alias("placement"), F.avg(F.when(F.col("type") == "image", F.expr(_ASPECT))).alias("aspect"), F.avg(F.when(F.col("type") == "rectangle", F.expr(_IN))).alias("boundary")
    ).na.fill(1.0)
    total = 0.4 * F.col("placement") + 0.3 * F.col("aspect") + 0.3 * F.col("boundary") - F.least(F.lit(0.25), F.coalesce("twins", F.lit(0)) * 0.05)
    return parts.join(twins, "page_id", "left").select("page_id", F.greatest(F.lit(0.0), total).alias("structure"), F.coalesce("twins", F.lit(0)).alias("twins"))


_STRUCTURE = f"""s2 AS (SELECT page_id, pos, type, x1, y1, x2, y2, CASE WHEN type = 'text' THEN lower(trim(text)) ELSE group_id END AS same FROM x WHERE type IN ('text', 'image') AND visible),
    tw AS (SELECT a.page_id, count(*) AS twins FROM s2 a JOIN s2 b ON a.page_id = b.page_id AND a.pos < b.pos AND a.type = b.type AND a.same = b.same
      AND greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / greatest(least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)), 1.0) > 0.85 GROUP BY a.page_id),
    pa AS (SELECT page_id, coalesce(avg(CASE WHEN type = 'text' THEN {_IN} END), 1.0) AS placement, coalesce(avg(CASE WHEN type = 'image' THEN {_ASPECT} END), 1.0) AS aspect, coalesce(avg(CASE WHEN type = 'rectangle' THEN {_IN} END), 1.0) AS boundary FROM x GROUP BY page_id),
    st AS (SELECT page_id, greatest(0.0, 0.4::DOUBLE * placement + 0.3::DOUBLE * aspect + 0.3::DOUBLE * boundary - least(0.25::DOUBLE, coalesce(twins, 0) * 0.05::DOUBLE)) AS structure, coalesce(twins, 0) AS twins FROM pa LEFT JOIN tw USING (page_id))"""
rule("agg07_structure", lambda x: structure(x).select("page_id", F.round("structure", 4).alias("score"), "twins"), f", {_STRUCTURE} SELECT page_id, round(structure, 4) AS score, twins FROM st")


def overall(x: DataFrame) -> DataFrame:
    """The weighted scores less three penalties, each with a cap."""
    by_type = x.groupBy("page_id").agg(*(F.coalesce(F.avg(F.when(F.col("type") == t, F.col("confidence"))), F.lit(1.0)).alias(t) for t in ("text", "image", "rectangle", "ellipse", "line")), F.avg("alike").alias("colour"))
    both = by_type.join(measured(x).select("page_id", "ghosts"), "page_id").join(structure(x), "page_id")
    total = 0.23 * F.col("image") + 0.18 * F.col("text") + 0.14 * F.col("rectangle") + 0.10 * F.col("ellipse") + 0.05 * F.col("colour") + 0.05 * F.col("line") + 0.25 * F.col("structure")
    return both.select("page_id", F.round(_unit(total - F.least(F.lit(0.3), F.col("ghosts") * 0.018) - F.least(F.lit(0.25), F.col("twins") * 0.05) - F.least(F.lit(0.2), F.col("twins") * 0.04)), 4).alias("overall"))


rule(
    "agg09_overall",
    overall,
    f""", {_MEASURED}, {_STRUCTURE}, c AS (SELECT page_id, {', '.join(f"coalesce(avg(CASE WHEN type = '{t}' THEN confidence END), 1.0) AS c_{t}" for t in ('text', 'image', 'rectangle', 'ellipse', 'line'))}, avg(alike) AS colour FROM x GROUP BY page_id)
    SELECT page_id, round(greatest(0.0, least(1.0, 0.23::DOUBLE * c_image + 0.18::DOUBLE * c_text + 0.14::DOUBLE * c_rectangle + 0.10::DOUBLE * c_ellipse + 0.05::DOUBLE * colour + 0.05::DOUBLE * c_line + 0.25::DOUBLE * structure
      - least(0.3::DOUBLE, ghosts * 0.018::DOUBLE) - least(0.25::DOUBLE, st.twins * 0.05::DOUBLE) - least(0.2::DOUBLE, st.twins * 0.04::DOUBLE))), 4) AS overall FROM c JOIN v USING (page_id) JOIN st USING (page_id)""",
)
rule(
    "agg23_inventory",
    lambda x: x.where("type = 'image'").join(x.where("element_id * 13 % 17 <> 0").select("element_id", F.lit(True).alias("stored")), "element_id", "left").groupBy("page_id").agg(F.count_if("visible").alias("shown"), F.count_if(F.col("visible") & (F.col("whole") | F.col("role").isin("logo", "badge"))).alias("protected"), F.count_if(F.col("visible") & F.col("stored").isNull()).alias("missing"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("visible") & F.col("stored").isNull(), F.col("pos")))), ",").alias("missing_ids")),
    "SELECT page_id, count_if(visible) AS shown, count_if(visible AND (whole OR role IN ('logo', 'badge'))) AS protected, count_if(visible AND element_id * 13 % 17 = 0) AS missing, coalesce(string_agg(CASE WHEN visible AND element_id * 13 % 17 = 0 THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos), '') AS missing_ids FROM x WHERE type = 'image' GROUP BY page_id",
)

# projections and edits
rule(
    "prj11_module_row",
    lambda x: x.where("type <> 'text'").select(*KEY, *(F.floor(F.col(c) + 0.5).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")), looked_up(ALIAS, F.col("strategy"), F.col("strategy")).alias("strategy"), F.coalesce(F.col("owned_by"), F.col("element_id")).alias("owner"), (F.col("whole") & looked_up(ALIAS, F.col("strategy"), F.col("strategy")).isin("cutout_image", "mixed_component")).alias("preserve")),
    f"SELECT page_id, pos, {', '.join(f'CAST(floor({c} + 0.5) AS BIGINT) AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))}, {said(ALIAS, 'strategy', 'strategy')} AS strategy, coalesce(owned_by, element_id) AS owner, whole AND {said(ALIAS, 'strategy', 'strategy')} IN ('cutout_image', 'mixed_component') AS preserve FROM x WHERE type <> 'text'",
)


def mutated(x: DataFrame) -> DataFrame:
    """Edits of a page: 3 deletes all but a background, 5 copies with an offset to the top, 1 and 2 go to the top and bottom, 7 and 8 a step up and down."""
    page, at = Window.partitionBy("page_id"), F.col("pos") % 10
    z = F.when(at == 1, F.max("z_index").over(page) + 1).when(at == 2, F.min("z_index").over(page) - 1).when(at == 7, F.col("z_index") + 1).when(at == 8, F.greatest(F.col("z_index") - 1, F.lit(0))).otherwise(F.col("z_index"))
    edited = x.withColumns({"z": z, "top": F.max("z_index").over(page)})
    kept = edited.where((at != 3) | (F.col("strategy") == "background")).select(*KEY, "x1", "y1", "z")
    return kept.unionByName(edited.where(at == 5).select("page_id", (F.col("pos") + 1000).alias("pos"), (F.col("x1") + 20).alias("x1"), (F.col("y1") + 20).alias("y1"), (F.col("top") + 1).alias("z")))


rule(
    "prj13_editor_mutation",
    mutated,
    """, m AS (SELECT *, max(z_index) OVER (PARTITION BY page_id) AS hi, min(z_index) OVER (PARTITION BY page_id) AS lo FROM x)
    SELECT page_id, pos, x1, y1, CASE pos % 10 WHEN 1 THEN hi + 1 WHEN 2 THEN lo - 1 WHEN 7 THEN z_index + 1 WHEN 8 THEN greatest(z_index - 1, 0) ELSE z_index END AS z FROM m WHERE pos % 10 <> 3 OR strategy = 'background'
    UNION ALL SELECT page_id, pos + 1000, x1 + 20, y1 + 20, hi + 1 FROM m WHERE pos % 10 = 5""",
)
_FINE = {"x1": f"least(greatest(x1 - 30, 0.0), {W}.0)", "y1": f"least(greatest(y1 - 30, 0.0), {H}.0)", "x2": f"least(greatest(x2 - 30, 0.0), {W}.0)", "y2": f"least(greatest(y2 - 30, 0.0), {H}.0)"}
_TRAIL = ", ".join([*(f"{c} - 30 AS raw_{c}" for c in _FINE), *(f"{s} AS {c}" for c, s in _FINE.items()), " OR ".join(f"{c} - 30 <> {s}" for c, s in _FINE.items()) + " AS changed"])
rule("prj17_audit_trail", lambda x: x.selectExpr(*KEY, *(f"{c} - 30 AS raw_{c}" for c in _FINE), *(f"{s} AS {c}" for c, s in _FINE.items()), " OR ".join(f"{c} - 30 <> {s}" for c, s in _FINE.items()) + " AS changed"), f"SELECT page_id, pos, {_TRAIL} FROM x")

# joins
_DECLARED = ("member", "editable", "ignore")


@query(
    "joi12_module_members",
    f"""WITH {ELEMENTS}, {RICH}, m AS (SELECT page_id, pos AS module, element_id + k AS id, k, x1 - 200 AS mx1, y1 - 120 AS my1, x2 + 200 AS mx2, y2 + 120 AS my2 FROM x, (SELECT unnest(range(1, 10)) AS k) WHERE type = 'rectangle')
    SELECT m.page_id, module, x.pos AS member, CASE k % 3 WHEN 0 THEN 'member' WHEN 1 THEN 'editable' ELSE 'ignore' END AS kind FROM m JOIN x ON m.page_id = x.page_id AND m.id = x.element_id
      AND greatest(least(x.x2, mx2) - greatest(x.x1, mx1), 0) * greatest(least(x.y2, my2) - greatest(x.y1, my1), 0) / greatest(x.width * x.height, 1.0) >= 0.35""",
)
def module_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ids that a module declares those that the page has and the module covers by 35 %."""
    x = rich(spark, sf_dir)
    declared = F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.struct((F.col("element_id") + k).alias("id"), F.get(F.array(*map(F.lit, _DECLARED)), k % 3).alias("kind"))))
    m = x.where("type = 'rectangle'").select("page_id", F.col("pos").alias("module"), *((F.col(c) + d).alias(f"b_{c}") for c, d in (("x1", -200), ("y1", -120), ("x2", 200), ("y2", 120))), declared.alias("d"))
    e = x.select("page_id", "pos", "element_id", *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    return m.join(e, (m["page_id"] == e["page_id"]) & (F.col("d.id") == e["element_id"])).where(G.coverage(A(), B()) >= 0.35).select(m["page_id"], "module", F.col("pos").alias("member"), "d.kind")


@query(
    "joi16_text_like_asset",
    f"""WITH {ELEMENTS}, {RICH}, t AS (SELECT page_id, x1 - 60 AS x1, y1 - 20 AS y1, x2 + 60 AS x2, y2 + 20 AS y2 FROM x WHERE type = 'text' AND role IN ('title', 'subtitle', 'card_title') AND NOT suppressed)
    SELECT page_id, pos, EXISTS (SELECT 1 FROM t WHERE t.page_id = a.page_id AND greatest(least(a.x2, t.x2) - greatest(a.x1, t.x1), 0) * greatest(least(a.y2, t.y2) - greatest(a.y1, t.y1), 0) / greatest(a.width * a.height, 1.0) >= 0.5) AS hidden
    FROM x a WHERE type = 'image' AND whole AND NOT suppressed""",
)
def text_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-badge images that a title covers by half."""
    x = rich(spark, sf_dir)
    titles = x.where("type = 'text' AND role IN ('title', 'subtitle', 'card_title') AND NOT suppressed").withColumns({"x1": F.col("x1") - 60, "y1": F.col("y1") - 20, "x2": F.col("x2") + 60, "y2": F.col("y2") + 20})
    assets = x.where("type = 'image' AND whole AND NOT suppressed")
    hit = R.covered(assets, titles, 0.5).select(*KEY, F.lit(True).alias("hit"))
    return assets.join(hit, KEY, "left").select(*KEY, F.coalesce("hit", F.lit(False)).alias("hidden"))


@query(
    "joi26_image_ellipse",
    f"""WITH {ELEMENTS}, {RICH}, i AS (SELECT page_id, pos, group_id, x1 - 120 AS x1, y1 - 80 AS y1, x2 + 120 AS x2, y2 + 80 AS y2 FROM x WHERE type = 'image' AND group_id IS NOT NULL)
    SELECT i.page_id, i.pos, min(o.pos) AS ellipse FROM i JOIN x o ON i.page_id = o.page_id AND o.type = 'ellipse' AND o.group_id = i.group_id
      AND greatest(least(o.x2, i.x2) - greatest(o.x1, i.x1), 0) * greatest(least(o.y2, i.y2) - greatest(o.y1, i.y1), 0) / greatest(o.width * o.height, 1.0) >= 0.85 GROUP BY i.page_id, i.pos""",
)
def image_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ellipse of an image's group that the image covers by 85 %."""
    x = rich(spark, sf_dir)
    images = x.where("type = 'image' AND group_id IS NOT NULL").withColumns({"x1": F.col("x1") - 120, "y1": F.col("y1") - 80, "x2": F.col("x2") + 120, "y2": F.col("y2") + 80})
    p = R.pairs(images, x.where("type = 'ellipse'"), (F.col("a_group_id") == F.col("b_group_id")) & (G.coverage(B(), A()) >= 0.85))
    return p.groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.min("b_pos").alias("ellipse"))


# issues: one for each third element; a history of rounds that were tried before
_ISSUES = "is0 AS (SELECT page_id, pos, element_id, string_split('" + ",".join(PRIORITY) + "', ',')[CAST((element_id * 7 + pos) % " + str(len(PRIORITY)) + " + 1 AS INT)] AS problem, string_split('" + ",".join([*OVERRIDES, "other", "none", "faint", "edge"]) + "', ',')[CAST(element_id % 7 + 1 AS INT)] AS reason, CAST(width * height AS BIGINT) AS area, element_id % 5 = 0 AS tried, element_id % 2 = 0 AS taken, CASE WHEN element_id % 4 = 1 THEN 'v1' ELSE 'v2' END AS version FROM x WHERE pos % 3 = 0)"


def issues_of(x: DataFrame) -> DataFrame:
    problem = F.element_at(F.split(F.lit(",".join(PRIORITY)), ","), ((F.col("element_id") * 7 + F.col("pos")) % len(PRIORITY) + 1).cast("int"))
    reason = F.element_at(F.split(F.lit(",".join([*OVERRIDES, "other", "none", "faint", "edge"])), ","), (F.col("element_id") % 7 + 1).cast("int"))
    return x.where("pos % 3 = 0").select(*KEY, "element_id", problem.alias("problem"), reason.alias("reason"), (F.col("width") * F.col("height")).cast("long").alias("area"), (F.col("element_id") % 5 == 0).alias("tried"), (F.col("element_id") % 2 == 0).alias("taken"), F.when(F.col("element_id") % 4 == 1, "v1").otherwise("v2").alias("version"))


def targets(x: DataFrame) -> DataFrame:
    """The first four issues of a page by urgency and size, without those that a rejected round of this version has tried."""
    i = issues_of(x)
    tried = i.where("tried AND NOT taken AND version = 'v2'").select("page_id", "problem", "element_id")
    left = i.join(tried, ["page_id", "problem", "element_id"], "left_anti")
    urgency = F.when(F.col("reason").isin(*OVERRIDES), 0).otherwise(looked_up(PRIORITY, F.col("problem"), F.lit(9)))
    return first(left, ["page_id"], [urgency, F.desc("area"), "pos"], 4).select(*KEY, "problem", "nth")


rule(
    "srt01_targets",
    targets,
    f""", {_ISSUES}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN reason IN {OVERRIDES!r} THEN 0 ELSE {said(PRIORITY, 'problem', '9')} END, area DESC, pos) AS nth FROM is0 WHERE NOT (tried AND NOT taken AND version = 'v2'))
    SELECT page_id, pos, problem, CAST(nth AS INT) AS nth FROM k WHERE nth <= 4""",
)
rule(
    "win12_revision_number",
    lambda x: issues_of(x).where("tried").withColumn("round", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).select(*KEY, "round", F.size(F.collect_set(F.when(~F.col("taken") & (F.col("version") == "v2"), F.col("problem"))).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))).alias("known")),
    f""", {_ISSUES}, h AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS round FROM is0 WHERE tried)
    SELECT a.page_id, a.pos, CAST(a.round AS INT) AS round, CAST(count(DISTINCT CASE WHEN NOT b.taken AND b.version = 'v2' THEN b.problem END) AS INT) AS known FROM h a LEFT JOIN h b ON a.page_id = b.page_id AND b.round < a.round GROUP BY a.page_id, a.pos, a.round""",
)


#: Ranges of a key in which rows are ranked.
RANGES = 256


@query(
    "srt06_even_sample",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS nth, count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem)
    SELECT l_linestatus, count(*) AS kept, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM n WHERE nth % greatest(1, n // 12000) = 0 GROUP BY l_linestatus""",
)
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th row of a kind, k being its number of rows over 12,000.

    Kinds are few and their rows many, so none is ranked as a whole: rows are ranked inside ranges of the first key, after
    those of the ranges before.
    """
    kind, keys = ("l_linestatus",), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*kind, *keys)
    bounds = rows.agg(F.percentile_approx("l_orderkey", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    splits = [-float("inf"), *sorted({float(b) for b in bounds}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="first", outputCol="range").transform(rows.withColumn("first", F.coalesce(F.col("l_orderkey").cast("double"), F.lit(-float("inf"))))).drop("first")
    counts = ranged.groupBy(*kind, "range").agg(F.count("*").alias("here"))
    whole = Window.partitionBy(*kind)
    sized = counts.withColumns({"before": F.coalesce(F.sum("here").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("here").over(whole)}).drop("here")
    ranked = ranged.withColumn("at", F.row_number().over(Window.partitionBy(*kind, "range").orderBy(*keys)) - 1)
    met = ranked.join(sized.select(F.col("l_linestatus").alias("kind"), F.col("range").alias("of"), "before", "n"), F.col("l_linestatus").eqNullSafe(F.col("kind")) & (F.col("range") == F.col("of")))
    n = met.withColumn("nth", F.col("before") + F.col("at"))
    return n.where(F.expr("nth % greatest(1, n div 12000) = 0")).groupBy("l_linestatus").agg(F.count("*").alias("kept"), F.sum("l_orderkey").alias("keys"))


def drawn(x: DataFrame) -> DataFrame:
    """How each element is drawn on a slide 13.333 inches wide: by its strategy, in inches, by draw order; hidden and grouped ones aren't."""
    plain = looked_up({"text": "editable_text", "image": "cutout_image"}, F.col("type"), F.lit("native_shape"))
    strategy = F.when(F.col("whole") & ~F.col("strategy").isin("cutout_image", "transparent_image"), "local_image").otherwise(F.when(F.col("strategy").isin("editable_text", "native_shape", "cutout_image", "group"), F.col("strategy")).otherwise(plain))
    s = x.where("NOT suppressed AND owned_by IS NULL").withColumn("s", strategy).where("s <> 'group'")
    what = F.when(F.col("s").isin("local_image", "cutout_image"), "picture").when(F.col("s") == "editable_text", "textbox").when(F.col("type") == "line", "connector").when(F.col("type").isin("rectangle", "ellipse"), F.col("type"))
    inch = 13.333 / W
    size = F.when(F.col("s") == "editable_text", F.round(F.greatest(F.lit(5.0), F.col("height") * inch * 72), 2))
    rows = s.withColumn("primitive", what).where("primitive IS NOT NULL").withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy("z_index", "pos")))
    return rows.select("page_id", "seq", "pos", "primitive", *(F.round(F.col(c) * inch, 4).alias(n) for c, n in (("x1", "left"), ("y1", "top"))), *(F.round(F.greatest(F.lit(0.01), F.col(c) * inch), 4).alias(c) for c in ("width", "height")), size.alias("points"))


_INCH = repr(13.333 / W)
_DRAWN = f"""d0 AS (SELECT *, CASE WHEN whole AND strategy NOT IN ('cutout_image', 'transparent_image') THEN 'local_image' WHEN strategy IN ('editable_text', 'native_shape', 'cutout_image', 'group') THEN strategy
      WHEN type = 'text' THEN 'editable_text' WHEN type = 'image' THEN 'cutout_image' ELSE 'native_shape' END AS s FROM x WHERE NOT suppressed AND owned_by IS NULL),
    d1 AS (SELECT *, CASE WHEN s IN ('local_image', 'cutout_image') THEN 'picture' WHEN s = 'editable_text' THEN 'textbox' WHEN type = 'line' THEN 'connector' WHEN type IN ('rectangle', 'ellipse') THEN type END AS primitive FROM d0 WHERE s <> 'group'),
    dr AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY z_index, pos) AS INT) AS seq, pos, primitive, round(x1 * {_INCH}::DOUBLE, 4) AS left, round(y1 * {_INCH}::DOUBLE, 4) AS top, round(greatest(0.01, width * {_INCH}::DOUBLE), 4) AS width, round(greatest(0.01, height * {_INCH}::DOUBLE), 4) AS height,
      CASE WHEN s = 'editable_text' THEN round(greatest(5.0, height * {_INCH}::DOUBLE * 72), 2) END AS points FROM d1 WHERE primitive IS NOT NULL)"""
rule("snk02_draw_ops", drawn, f", {_DRAWN} SELECT * FROM dr")
rule(
    "agg12_structural_counts",
    lambda x: drawn(x).groupBy("page_id").agg(F.count("*").alias("shapes"), *(F.count_if(F.col("primitive") == p).alias(n) for p, n in (("textbox", "texts"), ("picture", "pictures"), ("connector", "connectors")))).join(x.where("type = 'text'").groupBy("page_id").agg(F.count("*").alias("read")), "page_id").select("page_id", "shapes", "texts", "pictures", "connectors", F.round(F.least(F.lit(1.0), F.col("texts") / F.col("read")), 4).alias("coverage")),
    f", {_DRAWN}, n AS (SELECT page_id, count(*) AS shapes, count_if(primitive = 'textbox') AS texts, count_if(primitive = 'picture') AS pictures, count_if(primitive = 'connector') AS connectors FROM dr GROUP BY page_id), t AS (SELECT page_id, count(*) AS read FROM x WHERE type = 'text' GROUP BY page_id) SELECT page_id, shapes, texts, pictures, connectors, round(least(1.0, texts / read), 4) AS coverage FROM n JOIN t USING (page_id)",
)
_FACES = {"title": "Georgia", "subtitle": "Georgia", "card_title": "Arial", "label": "Arial"}
rule(
    "snk08_font_rows",
    lambda x: drawn(x).where("primitive = 'textbox'").join(x.select(*KEY, "role", "text"), KEY).select("page_id", "seq", looked_up(_FACES, F.col("role"), F.lit("Calibri")).alias("latin"), F.when(F.coalesce("text", F.lit("")).rlike("[1-4]$"), "SimSun").otherwise("Microsoft YaHei").alias("east_asian"), F.to_json(F.struct("seq", "points")).alias("validation")),
    f""", {_DRAWN} SELECT page_id, seq, {said(_FACES, 'role', "'Calibri'")} AS latin, CASE WHEN regexp_matches(coalesce(text, ''), '[1-4]$') THEN 'SimSun' ELSE 'Microsoft YaHei' END AS east_asian, '{{"seq":' || seq || ',"points":' || points || '}}' AS validation FROM dr JOIN (SELECT page_id, pos, role, text FROM x) USING (page_id, pos) WHERE primitive = 'textbox'""",
)


@query(
    "ras51_visual_present",
    f"""WITH {ELEMENTS}, {RICH} SELECT page_id, pos, delta >= 8 OR fill * width * height >= greatest(24.0, 0.001 * width * height) AND saturation > 200 OR EXISTS (SELECT 1 FROM x v WHERE v.page_id = m.page_id AND v.type IN ('image', 'ellipse') AND v.pos <> m.pos AND v.visible
      AND greatest(least(v.x2, m.x2) - greatest(v.x1, m.x1), 0) * greatest(least(v.y2, m.y2) - greatest(v.y1, m.y1), 0) / greatest(v.width * v.height, 1.0) >= 0.6) AS visual FROM x m WHERE type = 'rectangle'""",
)
def visual_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a module holds more than text: its colour differs from the page's, it has edges enough, or a visual lies in it."""
    x = rich(spark, sf_dir)
    m = x.where("type = 'rectangle'")
    p = R.pairs(m, x.where("type IN ('image', 'ellipse') AND visible"), G.coverage(B(), A()) >= 0.6).select("page_id", F.col("a_pos").alias("pos")).distinct().withColumn("held", F.lit(True))
    size = F.col("width") * F.col("height")
    edges = (F.col("fill") * F.col("width") * F.col("height") >= F.greatest(F.lit(24.0), 0.001 * size)) & (F.col("saturation") > 200)
    return m.join(p, KEY, "left").select(*KEY, ((F.col("delta") >= 8) | edges | F.coalesce("held", F.lit(False))).alias("visual"))


def guarded(x: DataFrame) -> DataFrame:
    """What becomes of a text that was drawn badly: kept, recoloured, hidden as unsure, or replaced by a cut of the source; a text that an image owns goes back to it."""
    owner = R.pairs(x.where("type = 'text'"), x.where("type = 'image' AND visible"), G.coverage(A(), B()) >= 0.6).groupBy("page_id", F.col("a_pos").alias("pos")).agg(F.min("b_pos").alias("owner"))
    ordinary = ~F.col("role").isin("logo", "decorative_text") & ~F.col("art")
    action = F.when(F.col("owner").isNotNull(), "owned").when(F.col("fill") >= 0.8, "kept").when(~ordinary, "cutout").when(F.col("confidence") < 0.35, "hidden").when((F.col("alike") >= 0.35) & (F.col("delta") < 60), "recoloured").otherwise("cutout")
    return x.where("type = 'text'").join(owner, KEY, "left").select(*KEY, action.alias("action"), "owner")


rule(
    "ras48_text_guard",
    guarded,
    """, o AS (SELECT t.page_id, t.pos, min(i.pos) AS owner FROM x t JOIN x i ON t.page_id = i.page_id AND t.type = 'text' AND i.type = 'image' AND i.visible
      AND greatest(least(t.x2, i.x2) - greatest(t.x1, i.x1), 0) * greatest(least(t.y2, i.y2) - greatest(t.y1, i.y1), 0) / greatest(t.width * t.height, 1.0) >= 0.6 GROUP BY t.page_id, t.pos)
    SELECT page_id, pos, CASE WHEN owner IS NOT NULL THEN 'owned' WHEN fill >= 0.8 THEN 'kept' WHEN role IN ('logo', 'decorative_text') OR art THEN 'cutout' WHEN confidence < 0.35 THEN 'hidden' WHEN alike >= 0.35 AND delta < 60 THEN 'recoloured' ELSE 'cutout' END AS action, owner FROM x LEFT JOIN o USING (page_id, pos) WHERE type = 'text'""",
)
rule("ras09_dense_artwork", lambda x: x.where("type = 'image'").select(*KEY, ((F.col("fill") >= 0.85) & ((F.col("complexity") >= 0.025) | (F.col("saturation") / 4 >= 18))).alias("dense")), "SELECT page_id, pos, fill >= 0.85 AND (complexity >= 0.025 OR saturation / 4 >= 18) AS dense FROM x WHERE type = 'image'")
rule(
    "ras06_ghosting_penalty",
    lambda x: x.groupBy("page_id").agg(F.avg(F.col("fill")).alias("before"), F.avg(F.greatest(F.col("fill"), F.col("complexity"))).alias("after")).select("page_id", F.round(F.least(F.lit(0.3), F.greatest(F.lit(0.0), F.col("after") - F.col("before")) * 1.8), 6).alias("penalty")),
    "SELECT page_id, round(least(0.3::DOUBLE, greatest(0.0, avg(greatest(fill, complexity)) - avg(fill)) * 1.8::DOUBLE), 6) AS penalty FROM x GROUP BY page_id",
)

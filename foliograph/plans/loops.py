"""Queries of rules that go in rounds, and of what decides whether a version of a page is taken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relations as R
from ..sources.views import ELEMENTS, OCR_LINES, PIXELS, RICH, elements, ocr_lines, pixels, rich
from .geometry import H, W
from .registry import add, query

KEY = ["page_id", "pos"]

# what an audit counted on a page before and after an edit: name, factor, modulus before and after
_COUNTS = {
    "salient": (7919, 60000, 61000), "missing": (31, 120, 260), "largest": (17, 60, 150), "mismatch": (13, 90, 140), "pale": (29, 5000, 5200), "support": (37, 4000, 4100), "washed": (41, 500, 900), "surface": (43, 200, 320), "monolithic": (3, 2, 3),
    "assets": (5, 12, 14), "shapes": (11, 9, 9), "issues": (19, 9, 9), "visuals": (23, 14, 15),
}
_SHARES = {"background_white": (53, 30), "preview_white": (59, 30), "overall": (61, 100), "coverage": (67, 100)}
_AUDIT = {f"{n}_{t}": f"(p * {f} + {7 * k}) % {m}" for n, (f, *ms) in _COUNTS.items() for k, (t, m) in enumerate(zip(("before", "after"), ms, strict=True))}
_AUDIT |= {f"{n}_{t}": f"cast((p * {f} + {3 * k}) % {m} as double) / 100" for n, (f, m) in _SHARES.items() for k, t in enumerate(("before", "after"))}
_AUDIT |= {"absent": "p % 6", "unreplaced": "(p * 3) % 8", "outside": "cast(p % 40 as double) / 1000", "newly_lost": "(p * 71) % 90", "new_loss": "(p * 73) % 40", "changed": "p % 5", "resolved": "p % 3", "restored": "p % 4"}
AUDITS = "au AS (SELECT p AS page_id, " + ", ".join(f"{s} AS {n}" for n, s in _AUDIT.items()) + " FROM (SELECT DISTINCT page_id AS p FROM e))"


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select(F.col("page_id").alias("p")).distinct().selectExpr("p AS page_id", *(f"{s} AS {n}" for n, s in _AUDIT.items()))


def grown(name: str) -> Column:
    return F.col(f"{name}_after") - F.col(f"{name}_before")


def regressed() -> Column:
    """Whether visuals were lost: to white, in fragments, to a wrong colour, pale or text support, colour, surface, or into one image for the page."""
    salient = F.greatest("salient_before", "salient_after")
    near_white = F.greatest(F.lit(24), F.least(F.lit(96), F.floor(salient * 2 / 10000 + 0.5)))
    white = (grown("missing") > near_white) & (F.col("largest_after") > near_white) & (F.col("largest_after") > F.col("largest_before") + 24)
    fragments = (salient > 0) & (grown("missing") > F.greatest(F.lit(96), F.floor(salient * 3 / 10000 + 0.5))) & (F.col("largest_after") > F.col("largest_before") + 8)
    colour = (salient > 0) & (grown("mismatch") > F.greatest(F.lit(48), F.floor(salient * 2 / 10000 + 0.5)))
    support = lambda n: grown(n) > F.greatest(F.lit(48), F.least(F.lit(300), F.floor(F.col(f"{n}_before") * 15 / 1000 + 0.5)))
    return white | fragments | colour | support("pale") | support("support") | (grown("washed") > 200) | (grown("surface") > 100) | (grown("monolithic") > 0)


_NEAR_WHITE = "greatest(24, least(96, floor(greatest(salient_before, salient_after) * 2 / 10000 + 0.5)))"
_REGRESSED = f"""((missing_after - missing_before > {_NEAR_WHITE} AND largest_after > {_NEAR_WHITE} AND largest_after > largest_before + 24)
  OR (greatest(salient_before, salient_after) > 0 AND missing_after - missing_before > greatest(96, floor(greatest(salient_before, salient_after) * 3 / 10000 + 0.5)) AND largest_after > largest_before + 8)
  OR (greatest(salient_before, salient_after) > 0 AND mismatch_after - mismatch_before > greatest(48, floor(greatest(salient_before, salient_after) * 2 / 10000 + 0.5)))
  OR pale_after - pale_before > greatest(48, least(300, floor(pale_before * 15 / 1000 + 0.5))) OR support_after - support_before > greatest(48, least(300, floor(support_before * 15 / 1000 + 0.5)))
  OR washed_after - washed_before > 200 OR surface_after - surface_before > 100 OR monolithic_after > monolithic_before)"""
add("sta05_regression", lambda s, d: audits(s, d).select("page_id", regressed().alias("regressed")), f"WITH {ELEMENTS}, {AUDITS} SELECT page_id, {_REGRESSED} AS regressed FROM au")

ERRORS: dict[str, str] = {
    "missing_assets": "absent > 4", "lost_existing_images": "unreplaced > 5 OR assets_after < assets_before", "lost_existing_shapes": "shapes_after < shapes_before", "background_over_whitened": "round(background_white_after - background_white_before, 6) > 0.035",
    "preview_over_whitened": "round(preview_white_after - preview_white_before, 6) > 0.035", "new_source_visual_loss": "new_loss >= 24 OR newly_lost >= 64", "untargeted_preview_change": "outside > 0.015", "lost_visual_objects": "visuals_after < visuals_before - 1",
    "coverage_dropped": "round(coverage_after - coverage_before, 6) < -0.20", "score_dropped": "round(overall_after - overall_before, 6) < -0.30", "nothing_changed": "changed = 0",
}


def errors() -> Column:
    """Names of what speaks against a version, in order."""
    return F.array_compact(F.array(*(F.when(F.expr(sql), name) for name, sql in ERRORS.items()), F.when(regressed(), "visual_retention_regressed")))


_ERRORS = "concat_ws(',', " + ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in ERRORS.items()) + f", CASE WHEN {_REGRESSED} THEN 'visual_retention_regressed' END)"
add("sta04_verdict", lambda s, d: audits(s, d).select("page_id", F.array_join(errors(), ",").alias("errors")), f"WITH {ELEMENTS}, {AUDITS} SELECT page_id, {_ERRORS} AS errors FROM au")


def accepted() -> Column:
    """No error, something changed, one of five things is better, and at most one issue more."""
    visual, cover = F.round(grown("overall"), 6), F.round(grown("coverage"), 6)
    better = ((visual > 0.003) & (cover >= -0.01)) | ((cover > 0.02) & (visual >= -0.12)) | ((F.col("resolved") > 0) & (visual >= -0.005) & (cover >= -0.01))
    better = better | ((F.col("restored") > 0) & (F.col("mismatch_before") > 0) & (F.col("mismatch_after") * 5 < F.col("mismatch_before")) & (cover >= -0.01))
    better = better | ((F.col("pale_before") - F.col("pale_after") >= 120) & (visual >= -0.005) & (cover >= -0.01))
    return (F.size(F.filter(errors(), lambda x: ~x.isin("score_dropped", "preview_over_whitened", "lost_existing_shapes", "lost_existing_images"))) == 0) & (F.col("changed") > 0) & better & (grown("issues") <= 1)


_V, _C = "round(overall_after - overall_before, 6)", "round(coverage_after - coverage_before, 6)"
_HARD = " OR ".join(f"({sql})" for name, sql in ERRORS.items() if name not in ("score_dropped", "preview_over_whitened", "lost_existing_shapes", "lost_existing_images"))
_ACCEPTED = f"""(NOT ({_HARD} OR {_REGRESSED}) AND changed > 0 AND issues_after - issues_before <= 1 AND (({_V} > 0.003 AND {_C} >= -0.01) OR ({_C} > 0.02 AND {_V} >= -0.12) OR (resolved > 0 AND {_V} >= -0.005 AND {_C} >= -0.01)
  OR (restored > 0 AND mismatch_before > 0 AND mismatch_after * 5 < mismatch_before AND {_C} >= -0.01) OR (pale_before - pale_after >= 120 AND {_V} >= -0.005 AND {_C} >= -0.01)))"""
add("sta03_accept", lambda s, d: audits(s, d).select("page_id", accepted().alias("accepted")), f"WITH {ELEMENTS}, {AUDITS} SELECT page_id, {_ACCEPTED} AS accepted FROM au")


@query(
    "sta02_revision",
    f"""WITH {ELEMENTS}, {AUDITS}, v AS (SELECT page_id, CASE WHEN {_ACCEPTED} THEN 2 ELSE 1 END AS version FROM au)
    SELECT e.page_id, pos, CAST(version AS INT) AS version, CASE WHEN version = 2 THEN least(x1 + 5, {W}.0 - width) ELSE x1 END AS x1 FROM e JOIN v ON e.page_id = v.page_id WHERE version = 1 OR pos % 13 <> 0""",
)
def revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with a pointer: the new rows are staged beside the old ones, a page's pointer moves if its new version is accepted, and a page is what its pointer says.

    A stage that fails, or that is never accepted, changes nothing: the rows of the version before are still there.
    """
    e = elements(spark, sf_dir)
    old = e.select(*KEY, F.lit(1).alias("version"), "x1")
    new = e.where("pos % 13 <> 0").select(*KEY, F.lit(2).alias("version"), F.least(F.col("x1") + 5, W - F.col("width")).alias("x1"))
    pointer = audits(spark, sf_dir).select("page_id", F.when(accepted(), 2).otherwise(1).alias("version"))
    return old.unionByName(new).join(pointer, ["page_id", "version"]).select(*KEY, "version", "x1")


_PROBLEMS = ("criticalRegionMismatch", "ghosting", "brokenChartOrModule", "textOverlap", "backgroundResidual", "wrongBBox")
_BAD = ("criticalRegionMismatch", "brokenChartOrModule", "assetBakedIntoBackground", "backgroundResidual", "professionalInpaintingPending")


@query(
    "sta07_downgrade",
    f"""WITH {ELEMENTS}, {RICH}, i AS (SELECT *, string_split('{','.join(_PROBLEMS)}', ',')[CAST((element_id * 5 + pos) % 6 + 1 AS INT)] AS problem FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM i WHERE problem IN {_BAD!r} AND type <> 'text' AND NOT suppressed AND width >= 24 AND height >= 24)
    SELECT page_id, pos, 'fallback_' || (page_id + 1) || '_' || nth AS module, role, greatest(0.0, x1 / {W}) AS "left", greatest(0.0, y1 / {H}) AS top, least(1.0, width / {W}) AS width, least(1.0, height / {H}) AS height FROM k WHERE nth <= 8""",
)
def downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight regions of a page that checks complain of, as modules that become whole images."""
    problem = F.element_at(F.array(*map(F.lit, _PROBLEMS)), ((F.col("element_id") * 5 + F.col("pos")) % 6 + 1).cast("int"))
    i = rich(spark, sf_dir).withColumn("problem", problem).where(F.col("problem").isin(*_BAD) & (F.col("type") != "text") & ~F.col("suppressed") & (F.col("width") >= 24) & (F.col("height") >= 24))
    k = i.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("nth <= 8")
    share = lambda c, of: F.least(F.lit(1.0), F.col(c) / of)
    name = F.concat(F.lit("fallback_"), (F.col("page_id") + 1).cast("string"), F.lit("_"), F.col("nth").cast("string"))
    return k.select(*KEY, name.alias("module"), "role", F.greatest(F.lit(0.0), F.col("x1") / W).alias("left"), F.greatest(F.lit(0.0), F.col("y1") / H).alias("top"), share("width", W).alias("width"), share("height", H).alias("height"))


_STATE = "SELECT page_id // 8 AS project, event, page_id, stamp FROM (SELECT page_id, CASE element_id % 3 WHEN 0 THEN 'append' WHEN 1 THEN 'approve' ELSE 'save' END AS event, element_id AS stamp FROM e)"


@query(
    "sta01_project_state",
    f"""WITH {ELEMENTS}, v AS ({_STATE}) SELECT project, count_if(event = 'append') AS images, coalesce((SELECT string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FROM (SELECT DISTINCT w.page_id FROM v w WHERE w.project = v.project AND w.event = 'approve')), '') AS approved,
      max(CASE WHEN event = 'save' THEN stamp END) AS saved FROM v GROUP BY project""",
)
def project_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's state from its events: images are appended, approved pages are a sorted set, of saves the last counts."""
    e = elements(spark, sf_dir)
    event = F.get(F.array(F.lit("append"), F.lit("approve"), F.lit("save")), (F.col("element_id") % 3).cast("int"))
    v = e.select(F.expr("page_id div 8").alias("project"), event.alias("event"), "page_id", F.col("element_id").alias("at"))
    pages = F.array_join(F.sort_array(F.collect_set(F.when(F.col("event") == "approve", F.col("page_id")))).cast("array<string>"), ",")
    return v.groupBy("project").agg(F.count_if(F.col("event") == "append").alias("images"), pages.alias("approved"), F.max(F.when(F.col("event") == "save", F.col("at"))).alias("saved"))


_CUT = "greatest(least(t.x2, r.x2) - greatest(t.x1, r.x1), 0) * greatest(least(t.y2, r.y2) - greatest(t.y1, r.y1), 0) / greatest((t.x2 - t.x1) * (t.y2 - t.y1), 1.0)"


@query(
    "geo19_text_edges",
    f"""WITH RECURSIVE {ELEMENTS}, m AS (SELECT page_id, pos, x1, y1, x2, y2, greatest(12.0, round_even(least(x2 - x1, y2 - y1) * 0.25, 0)) AS most FROM e WHERE type = 'image'),
    t0 AS (SELECT page_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY page_id) AS n FROM e WHERE type = 'text'),
    t AS (SELECT page_id, x1, y1, x2, y2, n * k + nth AS step, nth = n AS ends FROM t0, (SELECT unnest([0, 1, 2]) AS k)),
    r AS (SELECT page_id, pos, x1, y1, x2, y2, x1 AS ox1, y1 AS oy1, x2 AS ox2, y2 AS oy2, most, CAST(0 AS BIGINT) AS step, false AS lost FROM m
      UNION ALL SELECT page_id, pos, CASE WHEN hit THEN nx1 ELSE x1 END, CASE WHEN hit THEN ny1 ELSE y1 END, CASE WHEN hit THEN nx2 ELSE x2 END, CASE WHEN hit THEN ny2 ELSE y2 END, ox1, oy1, ox2, oy2, most, step,
        lost OR (hit AND (abs(nx1 - ox1) > most OR abs(ny1 - oy1) > most OR abs(nx2 - ox2) > most OR abs(ny2 - oy2) > most))
        FROM (SELECT r.page_id, r.pos, r.x1, r.y1, r.x2, r.y2, ox1, oy1, ox2, oy2, most, t.step, lost, {_CUT} > 0.03 AND {_CUT} < 0.95 AS hit, greatest(0.0, least(r.x1, t.x1 - 2)) AS nx1, greatest(0.0, least(r.y1, t.y1 - 2)) AS ny1, least({W}.0, greatest(r.x2, t.x2 + 2)) AS nx2, least({H}.0, greatest(r.y2, t.y2 + 2)) AS ny2
          FROM r JOIN t ON r.page_id = t.page_id AND t.step = r.step + 1)),
    l AS (SELECT *, row_number() OVER (PARTITION BY page_id, pos ORDER BY step DESC) AS last FROM r), f AS (SELECT * FROM l WHERE last = 1),
    c AS (SELECT r.page_id, r.pos, bool_or({_CUT} > 0.03 AND {_CUT} < 0.95) AS still FROM f r JOIN t0 t ON r.page_id = t.page_id GROUP BY r.page_id, r.pos)
    SELECT page_id, pos, x1, y1, x2, y2 FROM f LEFT JOIN c USING (page_id, pos) WHERE NOT lost AND NOT coalesce(still, false)""",
)
def text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops pulled out so that they don't cut through texts: three rounds over a page's texts, each cut one moves the edges; a crop that would move too far, or still cuts one, is none."""
    e = elements(spark, sf_dir)
    texts = e.where("type = 'text'").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x1", "y1", "x2", "y2"))).alias("texts"))
    most = F.greatest(F.lit(12.0), F.bround(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 0.25, 0))
    m = e.where("type = 'image'").withColumn("most", most).join(texts, "page_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<struct<pos:int,x1:double,y1:double,x2:double,y2:double>>")))

    def part(box: Column, t: Column) -> Column:
        wide = F.greatest(F.least(t["x2"], box["x2"]) - F.greatest(t["x1"], box["x1"]), F.lit(0.0))
        high = F.greatest(F.least(t["y2"], box["y2"]) - F.greatest(t["y1"], box["y1"]), F.lit(0.0))
        return wide * high / F.greatest((t["x2"] - t["x1"]) * (t["y2"] - t["y1"]), F.lit(1.0))

    def cut_by(box: Column, t: Column) -> Column:
        return (part(box, t) > 0.03) & (part(box, t) < 0.95)

    def pulled(box: Column, t: Column) -> Column:
        to = {"x1": F.greatest(F.lit(0.0), F.least(box["x1"], t["x1"] - 2)), "y1": F.greatest(F.lit(0.0), F.least(box["y1"], t["y1"] - 2)), "x2": F.least(F.lit(float(W)), F.greatest(box["x2"], t["x2"] + 2)), "y2": F.least(F.lit(float(H)), F.greatest(box["y2"], t["y2"] + 2))}
        far = reduce(lambda a, b: a | b, (F.abs(c - F.col(n)) > F.col("most") for n, c in to.items()))
        hit = cut_by(box, t)
        return F.struct(*(F.when(hit, c).otherwise(box[n]).alias(n) for n, c in to.items()), (box["lost"] | (hit & far)).alias("lost"))

    start = F.struct(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(False).alias("lost"))
    done = m.withColumn("box", F.aggregate(F.concat("texts", "texts", "texts"), start, pulled))
    still = F.exists("texts", lambda t: cut_by(F.col("box"), t))
    return done.where(~F.col("box.lost") & ~still).select(*KEY, *(F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(
    "sca06_ocr_line_fit",
    f"""WITH {OCR_LINES}, t AS (SELECT page_id, pos, trim(replace(text, chr(10), ' ')) AS text, x1, y1, greatest(4.0, x2 - x1) AS w, greatest(4.0, y2 - y1) AS h FROM o), s AS (SELECT *, greatest(1.12::DOUBLE * h, 6.0) AS start FROM t WHERE text <> ''),
    k AS (SELECT *, unnest(range(0, CAST(ceil((start - 6) * 2) AS INT) + 1)) AS step FROM s), z AS (SELECT page_id, pos, x1, y1, w, h, length(text) AS n, max(CASE WHEN 0.56::DOUBLE * length(text) * greatest(start - step * 0.5, 6.0) <= 1.08::DOUBLE * w THEN greatest(start - step * 0.5, 6.0) END) AS size FROM k GROUP BY ALL)
    SELECT page_id, pos, x1, y1, round(coalesce(size, 6.0), 2) AS size, least({W}.0 - x1, greatest(w * 1.08::DOUBLE, 0.56::DOUBLE * n * coalesce(size, 6.0) + 2)) AS width, greatest(h * 1.4::DOUBLE, coalesce(size, 6.0) * 1.4::DOUBLE) AS height FROM z""",
)
def ocr_line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest size, in steps of half a pixel down from 1.12 of the line's height, at which a line is no wider than 1.08 of its box; 6 at least. Widths are estimates."""
    o = ocr_lines(spark, sf_dir).select(*KEY, F.trim(F.regexp_replace("text", "\n", " ")).alias("text"), "x1", "y1", F.greatest(F.lit(4.0), F.col("x2") - F.col("x1")).alias("w"), F.greatest(F.lit(4.0), F.col("y2") - F.col("y1")).alias("h")).where("text <> ''")
    wide, start = 0.56 * F.length("text"), F.greatest(1.12 * F.col("h"), F.lit(6.0))
    sizes = F.transform(F.sequence(F.lit(0), F.ceil((start - 6) * 2).cast("int")), lambda k: F.greatest(start - k * 0.5, F.lit(6.0)))
    size = F.coalesce(F.array_max(F.filter(sizes, lambda z: wide * z <= 1.08 * F.col("w"))), F.lit(6.0))
    return o.withColumn("z", size).select(*KEY, "x1", "y1", F.round("z", 2).alias("size"), F.least(W - F.col("x1"), F.greatest(F.col("w") * 1.08, wide * F.col("z") + 2)).alias("width"), F.greatest(F.col("h") * 1.4, F.col("z") * 1.4).alias("height"))


# pixels
_BIN = "(floor(v / 16.0) * 256 + floor((v * 3 % 256) / 16.0) * 16 + floor((v * 7 % 256) / 16.0))"


@query(
    "agg16_histogram",
    f"""WITH {PIXELS}, b AS (SELECT page_id, CAST({_BIN} AS INT) AS bin, count(*) AS n FROM px GROUP BY ALL), t AS (SELECT bin, row_number() OVER (ORDER BY sum(n) DESC, bin) AS place FROM b GROUP BY bin),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, bin) AS nth FROM b) SELECT page_id, bin, n, CAST(nth AS INT) AS nth, CAST(CASE WHEN place <= 40 THEN place END AS INT) AS place FROM k JOIN t USING (bin) WHERE nth <= 8""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in 4,096 bins: the eight commonest of a tile, the first being its mode, and their place among the forty commonest of all."""
    b = pixels(spark, sf_dir).groupBy("page_id", F.expr(f"cast({_BIN} as int)").alias("bin")).agg(F.count("*").alias("n"))
    top = b.groupBy("bin").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "bin").limit(40)
    places = top.agg(F.collect_list(F.struct((-F.col("all")).alias("a"), "bin")).alias("l")).select(F.posexplode(F.transform(F.array_sort("l"), lambda x: x["bin"])).alias("place", "bin"))
    k = b.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "bin"))).where("nth <= 8")
    return k.join(F.broadcast(places), "bin", "left").select("page_id", "bin", "n", "nth", (F.col("place") + 1).alias("place"))


@query("agg17_palette")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile's greys in two to six clusters by repeated means from evenly spaced starts: the largest, the darkest and the most different one."""
    import numpy as np
    import pandas as pd

    def of(tile: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(tile["v"].to_numpy(float))
        k = max(2, min(6, len(np.unique(v)) // 8))
        means = v[np.linspace(0, len(v) - 1, k).astype(int)]
        for _ in range(30):
            near = np.abs(v[:, None] - means).argmin(1)
            again = np.array([v[near == i].mean() if (near == i).any() else means[i] for i in range(k)])
            if np.array_equal(again, means):
                break
            means = again
        sizes = np.bincount(near, minlength=k)
        main = means[sizes.argmax()]
        return pd.DataFrame({"page_id": [tile["page_id"].iloc[0]], "clusters": [k], "dominant": [main], "dark": [means.min()], "accent": [means[np.abs(means - main).argmax()]]})

    return pixels(spark, sf_dir).groupBy("page_id").applyInPandas(of, "page_id bigint, clusters bigint, dominant double, dark double, accent double")


_AROUND = ((1, 0), (-1, 0), (0, 1), (0, -1))


def edges(p: DataFrame, at_least: int = 60) -> DataFrame:
    """Pixels whose Laplacian is strong; beyond the tile a pixel counts as its neighbour inside."""
    side = [p.select("page_id", (F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), F.col("v").alias(f"n{i}")) for i, (dx, dy) in enumerate(_AROUND)]
    joined = reduce(lambda a, b: a.join(b, ["page_id", "px", "py"], "left"), side, p)
    lap = sum((F.coalesce(f"n{i}", "v") for i in range(4)), F.lit(0)) - 4 * F.col("v")
    return joined.where(F.abs(lap) >= at_least).select("page_id", "px", "py", "v")


_EDGES = "ed AS (SELECT p.page_id, p.px, p.py, p.v FROM px p " + " ".join(f"LEFT JOIN px n{i} ON n{i}.page_id = p.page_id AND n{i}.px = p.px + {dx} AND n{i}.py = p.py + {dy}" for i, (dx, dy) in enumerate(_AROUND)) + " WHERE abs(" + " + ".join(f"coalesce(n{i}.v, p.v)" for i in range(4)) + " - 4 * p.v) >= 60)"
add("ras10_edges", lambda s, d: edges(pixels(s, d)).select("page_id", "px", "py"), f"WITH {PIXELS}, {_EDGES} SELECT page_id, px, py FROM ed")
add(
    "ras18_text_ghosts",
    lambda s, d: edges(pixels(s, d)).groupBy("page_id", "py").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).groupBy("page_id").agg(F.count_if((F.col("n") >= 4) & (F.col("mean") < 128)).alias("ghosts"), F.count("*").alias("lines")),
    f"WITH {PIXELS}, {_EDGES}, l AS (SELECT page_id, py, count(*) AS n, avg(v) AS mean FROM ed GROUP BY page_id, py) SELECT page_id, count_if(n >= 4 AND mean < 128) AS ghosts, count(*) AS lines FROM l GROUP BY page_id",
)


@query(
    "ras27_glyph_blends",
    f"""WITH RECURSIVE {PIXELS}, c AS (SELECT page_id, px, py, v < 110 AS seed FROM px WHERE v < 140),
    r AS (SELECT page_id, px, py FROM c WHERE seed UNION SELECT c.page_id, c.px, c.py FROM r JOIN c ON c.page_id = r.page_id AND abs(c.px - r.px) <= 1 AND abs(c.py - r.py) <= 1) SELECT page_id, count(*) AS n, CAST(sum(px + 8 * py) AS BIGINT) AS places FROM r GROUP BY page_id""",
)
def glyph_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in the colour corridor that hang together with a dark seed: the components that hold one."""
    from ..operators.raster import run_components

    c = pixels(spark, sf_dir).where("v < 140")
    runs = run_components(c, F.lit(True))
    comp = runs.select("page_id", "py", "label", F.explode(F.transform(F.sequence("first", "last"), lambda x: x.cast("int"))).alias("px"))
    marked = comp.join(c.select("page_id", "px", "py", (F.col("v") < 110).alias("seed")), ["page_id", "px", "py"])
    held = marked.groupBy("page_id", "label").agg(F.bool_or("seed").alias("held"), F.count("*").alias("n"), F.sum(F.col("px") + 8 * F.col("py")).alias("places")).where("held")
    return held.groupBy("page_id").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))


def split(boxes: DataFrame, rounds: int = 3, large: float = 3000.0) -> DataFrame:
    """Boxes that are too large are halved along their longer side, and the halves again, three times at most; areas add up."""
    c = F.col
    for _ in range(rounds):
        wide, big = c("x2") - c("x1") >= c("y2") - c("y1"), (c("x2") - c("x1")) * (c("y2") - c("y1")) > large
        mx, my = F.floor((c("x1") + c("x2")) / 2).cast("double"), F.floor((c("y1") + c("y2")) / 2).cast("double")
        box = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
        whole = F.array(box(c("x1"), c("y1"), c("x2"), c("y2")))
        halves = F.when(wide, F.array(box(c("x1"), c("y1"), mx, c("y2")), box(mx, c("y1"), c("x2"), c("y2")))).otherwise(F.array(box(c("x1"), c("y1"), c("x2"), my), box(c("x1"), my, c("x2"), c("y2"))))
        boxes = boxes.select(*KEY, F.explode(F.when(big, halves).otherwise(whole)).alias("b")).select(*KEY, "b.*")
    return boxes


_BIG, _WIDE = "(x2 - x1) * (y2 - y1) > 3000", "x2 - x1 >= y2 - y1"


@query(
    "itr04_recursive_split",
    f"""WITH RECURSIVE {ELEMENTS}, r AS (SELECT page_id, pos, x1, y1, x2, y2, 0 AS depth FROM e WHERE type = 'image'
      UNION ALL SELECT page_id, pos, CASE WHEN k = 1 AND {_WIDE} THEN floor((x1 + x2) / 2) ELSE x1 END, CASE WHEN k = 1 AND NOT {_WIDE} THEN floor((y1 + y2) / 2) ELSE y1 END,
        CASE WHEN k = 0 AND {_WIDE} THEN floor((x1 + x2) / 2) ELSE x2 END, CASE WHEN k = 0 AND NOT {_WIDE} THEN floor((y1 + y2) / 2) ELSE y2 END, depth + 1 FROM r, (SELECT unnest([0, 1]) AS k) WHERE depth < 3 AND {_BIG})
    SELECT page_id, pos, x1, y1, x2, y2 FROM r WHERE NOT (depth < 3 AND {_BIG})""",
)
def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(elements(spark, sf_dir).where("type = 'image'").select(*KEY, "x1", "y1", "x2", "y2"))


@query(
    "joi27_group_anchor",
    f"""WITH {ELEMENTS}, {RICH}, t AS (SELECT * FROM x WHERE type = 'text' AND group_id IS NOT NULL), c AS (SELECT t.page_id, t.pos, arg_min(o.x1 + o.width / 2, o.pos) AS cx, arg_min(o.width, o.pos) AS cw FROM t JOIN x o ON o.page_id = t.page_id AND o.group_id = t.group_id AND o.type = 'ellipse' GROUP BY t.page_id, t.pos)
    SELECT t.page_id, t.pos, CASE WHEN abs(t.x1 + t.width / 2 - cx) < greatest(cw * 1.7::DOUBLE, 120.0) THEN greatest(0.0, cx - t.width / 2) ELSE t.x1 END AS x, CASE WHEN abs(t.x1 + t.width / 2 - cx) < greatest(cw * 1.7::DOUBLE, 120.0) THEN greatest(0.0, cx - t.width / 2) ELSE t.x1 END + t.width * 0.12::DOUBLE AS underline_x, greatest(20.0, t.width * 0.28::DOUBLE) AS underline_width, t.y2 + greatest(8.0, t.height * 0.18::DOUBLE) AS underline_y
    FROM t LEFT JOIN c USING (page_id, pos)""",
)
def group_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text is centred under its group's first circle if it is near it; its underline goes with it."""
    x = rich(spark, sf_dir)
    texts = x.where("type = 'text' AND group_id IS NOT NULL")
    p = R.pairs(texts, x.where("type = 'ellipse'"), F.col("a_group_id") == F.col("b_group_id"))
    circle = R.best(p, ["page_id", "a_pos"], F.col("b_pos"), cx=F.col("b_x1") + F.col("b_width") / 2, cw=F.col("b_width")).withColumnRenamed("a_pos", "pos")
    near = F.abs(F.col("x1") + F.col("width") / 2 - F.col("cx")) < F.greatest(F.col("cw") * 1.7, F.lit(120.0))
    at = F.when(near, F.greatest(F.lit(0.0), F.col("cx") - F.col("width") / 2)).otherwise(F.col("x1"))
    return texts.join(circle, KEY, "left").select(*KEY, at.alias("x"), (at + F.col("width") * 0.12).alias("underline_x"), F.greatest(F.lit(20.0), F.col("width") * 0.28).alias("underline_width"), (F.col("y2") + F.greatest(F.lit(8.0), F.col("height") * 0.18)).alias("underline_y"))


_BOUND = lambda old, to, most, high: f"least(greatest(least(greatest({to}, {old} - {most}), {old} + {most}), 0.0), {high})"


@query(
    "joi25_align_to_icon",
    f"""WITH {ELEMENTS}, {RICH}, t AS (SELECT * FROM x WHERE type = 'text' AND group_id IS NOT NULL), o AS (SELECT * FROM x WHERE (type = 'image' AND whole) OR type = 'ellipse'),
    c AS (SELECT t.page_id, t.pos, arg_min(o.pos, struct_pack(k := CASE WHEN o.type = 'image' THEN 0 ELSE 1 END, p := o.pos)) AS icon FROM t JOIN o ON o.page_id = t.page_id AND o.group_id = t.group_id AND o.pos <> t.pos GROUP BY t.page_id, t.pos),
    j AS (SELECT t.page_id, t.pos, t.x1, t.y1, t.x2, t.y2, t.width, t.height, o.x1 AS ix, o.y1 AS iy, o.width AS iw, o.height AS ih FROM t LEFT JOIN c USING (page_id, pos) LEFT JOIN o ON o.page_id = t.page_id AND o.pos = c.icon),
    k AS (SELECT *, CASE WHEN ix IS NULL THEN 'none' WHEN y1 >= iy + ih - ih * 0.18::DOUBLE THEN 'below' WHEN abs((y1 + y2) / 2 - (iy + ih / 2)) <= greatest(ih, height) * 0.72::DOUBLE AND ix + iw / 2 < (x1 + x2) / 2 THEN 'right' ELSE 'none' END AS side FROM j)
    SELECT page_id, pos, side, CASE side WHEN 'below' THEN {_BOUND('x1', 'ix + iw / 2 - width / 2', W * 0.025, f'{W}.0 - width')} WHEN 'right' THEN {_BOUND('x1', 'greatest(x1, ix + iw + greatest(4.0, iw * 0.08::DOUBLE))', W * 0.05, f'{W}.0 - width')} ELSE x1 END AS x,
      CASE side WHEN 'right' THEN {_BOUND('y1', 'iy + ih / 2 - height / 2', H * 0.02, f'{H}.0 - height')} ELSE y1 END AS y FROM k""",
)
def align_to_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text moves a little towards its group's badge, else its circle: under it to the middle, right of it to its edge and height."""
    x = rich(spark, sf_dir)
    texts = x.where("type = 'text' AND group_id IS NOT NULL")
    p = R.pairs(texts, x.where("(type = 'image' AND whole) OR type = 'ellipse'"), (F.col("a_group_id") == F.col("b_group_id")) & (F.col("a_pos") != F.col("b_pos")))
    icon = R.best(p, ["page_id", "a_pos"], F.struct(F.when(F.col("b_type") == "image", 0).otherwise(1).alias("k"), F.col("b_pos").alias("p")), ix=F.col("b_x1"), iy=F.col("b_y1"), iw=F.col("b_width"), ih=F.col("b_height")).withColumnRenamed("a_pos", "pos")
    c = F.col
    level = F.abs((c("y1") + c("y2")) / 2 - (c("iy") + c("ih") / 2)) <= F.greatest("ih", "height") * 0.72
    side = F.when(c("ix").isNull(), "none").when(c("y1") >= c("iy") + c("ih") - c("ih") * 0.18, "below").when(level & (c("ix") + c("iw") / 2 < (c("x1") + c("x2")) / 2), "right").otherwise("none")
    bound = lambda old, to, most, high: F.least(F.greatest(F.least(F.greatest(to, old - most), old + most), F.lit(0.0)), high)
    j = texts.join(icon, KEY, "left").withColumn("side", side)
    at_x = F.when(c("side") == "below", bound(c("x1"), c("ix") + c("iw") / 2 - c("width") / 2, W * 0.025, W - c("width"))).when(c("side") == "right", bound(c("x1"), F.greatest(c("x1"), c("ix") + c("iw") + F.greatest(F.lit(4.0), c("iw") * 0.08)), W * 0.05, W - c("width"))).otherwise(c("x1"))
    at_y = F.when(c("side") == "right", bound(c("y1"), c("iy") + c("ih") / 2 - c("height") / 2, H * 0.02, H - c("height"))).otherwise(c("y1"))
    return j.select(*KEY, "side", at_x.alias("x"), at_y.alias("y"))

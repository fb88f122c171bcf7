"""Queries of sources, payloads and providers: what comes in from outside, made tidy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relations as R
from ..sources import providers as P
from ..sources import store
from ..sources.pictures import spread
from ..sources.views import ELEMENTS, OCR_LINES, PIXELS, RICH, elements, ocr_lines, pixels, rich, table
from .registry import add, query

KEY = ["page_id", "pos"]
# Labels of a layout model by what they count as; other labels are content_region.
REGION_OF = {"paragraph_title": "title", "doc_title": "title", "figure": "figure", "chart": "figure", "image": "image", "table": "table", "header": "header", "footer": "footer", "text": "text"}
LABELS = ("doc_title", "Chart", "figure", "text", "formula", "paragraph_title", "table", "seal")


def of(values: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


# sources
@query(
    "src03_polygons",
    f"""WITH {OCR_LINES}, g AS (SELECT page_id, pos, trim(CASE WHEN pos % 5 = 4 THEN '  ' ELSE ' ' || text || ' ' END) AS text, [[x1 + 2, y1], [x2, y1 + 3], [x2 - 2, y2], [x1, y2 - 3]] AS poly, CASE WHEN pos % 3 > 0 THEN (pos * 7 % 10) / 10.0::DOUBLE END AS score FROM o)
    SELECT page_id, pos, text, list_min([p[1] FOR p IN poly]) AS x1, list_min([p[2] FOR p IN poly]) AS y1, list_max([p[1] FOR p IN poly]) AS x2, list_max([p[2] FOR p IN poly]) AS y2, coalesce(score, 0.8) AS confidence FROM g WHERE text <> ''""",
)
def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised polygons as boxes; blank texts go, a missing score is 0.8."""
    point = lambda x, y: F.array(x, y)
    c = F.col
    poly = F.array(point(c("x1") + 2, c("y1")), point(c("x2"), c("y1") + 3), point(c("x2") - 2, c("y2")), point(c("x1"), c("y2") - 3))
    raw = ocr_lines(spark, sf_dir).select(*KEY, F.trim(F.when(c("pos") % 5 == 4, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))).alias("text"), poly.alias("poly"), F.when(c("pos") % 3 > 0, (c("pos") * 7 % 10) / 10).alias("score"))
    side = lambda i, pick: pick(F.transform("poly", lambda p: F.get(p, F.lit(i))))
    return raw.where("text <> ''").select(*KEY, "text", side(0, F.array_min).alias("x1"), side(1, F.array_min).alias("y1"), side(0, F.array_max).alias("x2"), side(1, F.array_max).alias("y2"), F.coalesce("score", F.lit(0.8)).alias("confidence"))


_LABEL = f"string_split('{','.join(LABELS)}', ',')[CAST((element_id * 3 + pos) % {len(LABELS)} + 1 AS INT)]"


@query(
    "src04_layout_regions",
    f"""WITH {ELEMENTS}, l AS (SELECT page_id, pos, {_LABEL} AS label, x1 + width / 2 AS cx, y1 + height / 2 AS cy, CASE WHEN pos % 4 = 0 THEN pos // 4 END AS place FROM e),
    n AS (SELECT a.page_id, a.pos, arg_min(b.place, struct_pack(d := (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy), p := b.pos)) AS near FROM l a JOIN l b ON a.page_id = b.page_id AND a.label = b.label AND b.place IS NOT NULL GROUP BY a.page_id, a.pos)
    SELECT page_id, pos, {of(REGION_OF, 'lower(label)', "'content_region'")} AS region, CAST(coalesce(place, near) AS INT) AS reading_order FROM l LEFT JOIN n USING (page_id, pos)""",
)
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by what their label counts as; the place of one without is that of the nearest block of its label."""
    e = elements(spark, sf_dir)
    label = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("element_id") * 3 + F.col("pos")) % len(LABELS) + 1).cast("int"))
    l = e.withColumns({"label": label, "place": F.when(F.col("pos") % 4 == 0, F.expr("cast(pos div 4 as int)"))})
    near = R.nearest(l, l.where("place IS NOT NULL"), F.col("a_label") == F.col("b_label"))
    placed = near.join(l.select("page_id", F.col("pos").alias("b_pos"), F.col("place").alias("near")), ["page_id", "b_pos"]).select("page_id", F.col("a_pos").alias("pos"), "near")
    region = F.coalesce(*(F.when(F.lower("label") == k, v) for k, v in REGION_OF.items()), F.lit("content_region"))
    return l.join(placed, KEY, "left").select(*KEY, region.alias("region"), F.coalesce("place", "near").alias("reading_order"))


_NAMES = "n AS (SELECT DISTINCT CASE WHEN page_id % 5 = 0 THEN 'zz-' ELSE '' END || md5(CAST(page_id // 10 AS VARCHAR)) AS project, 'page_' || page_id || CASE WHEN page_id % 7 = 3 THEN '.tmp' ELSE '.json' END AS file FROM e)"


@query("src08_store_list", f"WITH {ELEMENTS}, {_NAMES} SELECT project, file, CAST(row_number() OVER (PARTITION BY project ORDER BY CAST(regexp_extract(file, '(\\d+)', 1) AS BIGINT)) AS INT) AS nth FROM n WHERE regexp_full_match(project, '[0-9a-f]+') AND regexp_full_match(file, 'page_\\d+\\.json')")
def store_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slides of each project by page number; names that aren't pages, and projects whose id isn't hexadecimal, don't count."""
    c = F.col("page_id")
    names = elements(spark, sf_dir).select(F.concat(F.when(c % 5 == 0, "zz-").otherwise(""), F.md5(F.expr("page_id div 10").cast("string"))).alias("project"), F.concat(F.lit("page_"), c.cast("string"), F.when(c % 7 == 3, ".tmp").otherwise(".json")).alias("file")).distinct()
    kept = names.where(F.col("project").rlike("^[0-9a-f]+$") & F.col("file").rlike("^page_\\d+\\.json$"))
    number = F.regexp_extract("file", "(\\d+)", 1).cast("long")
    return kept.select("project", "file", F.row_number().over(Window.partitionBy("project").orderBy(number)).alias("nth"))


# three ways to a service in turn: an answer ends them, and only what the network or the server does to one leads to the next
_TRIES = """t AS (SELECT page_id, way, CASE WHEN (page_id * 7 + way * 3) % 5 = 0 THEN 0 ELSE string_split('200,401,408,503,200,429,500', ',')[CAST((page_id * 11 + way) % 7 + 1 AS INT)]::INT END AS status
  FROM (SELECT DISTINCT page_id FROM e), (SELECT unnest(range(0, 3)) AS way))"""


@query(
    "src09_connection_paths",
    f"""WITH {ELEMENTS}, {_TRIES}, s AS (SELECT *, status = 0 OR status = 408 OR status >= 500 AS goes_on FROM t), f AS (SELECT page_id, min(CASE WHEN NOT goes_on THEN way END) AS last FROM s GROUP BY page_id)
    SELECT page_id, CAST(count(*) AS INT) AS attempts, string_agg(CAST(status AS VARCHAR), ',' ORDER BY way) AS statuses, arg_max(status, way) = 200 AS connected FROM s JOIN f USING (page_id) WHERE way <= coalesce(last, 2) GROUP BY page_id""",
)
def connection_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of each request: direct, then over proxies, as long as the network fails or the server is out of order."""
    c = F.col("page_id")
    way = F.explode(F.sequence(F.lit(0), F.lit(2)))
    tries = elements(spark, sf_dir).select("page_id").distinct().withColumn("way", way)
    status = F.when((c * 7 + F.col("way") * 3) % 5 == 0, 0).otherwise(F.element_at(F.array(*(F.lit(x) for x in (200, 401, 408, 503, 200, 429, 500))), ((c * 11 + F.col("way")) % 7 + 1).cast("int")))
    s = tries.withColumn("status", status).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("way", "status"))), lambda x: x["status"]).alias("all"))
    goes_on = lambda x: (x == 0) | (x == 408) | (x >= 500)
    ended = F.coalesce(F.array_min(F.filter(F.transform("all", lambda x, i: F.when(~goes_on(x), i + 1)), lambda i: i.isNotNull())), F.lit(3))
    return s.withColumn("made", F.slice("all", F.lit(1), ended)).select("page_id", F.size("made").alias("attempts"), F.array_join(F.col("made").cast("array<string>"), ",").alias("statuses"), (F.element_at("made", -1) == 200).alias("connected"))


@query(
    "src10_plan_retry",
    f"""WITH {ELEMENTS}, {RICH}, a AS (SELECT * FROM x WHERE type = 'text'), b AS (SELECT page_id, pos, pos % 3 <> 0 AS first, pos % 9 <> 0 AS second FROM a)
    SELECT page_id, count_if(NOT first) AS asked_again, count_if(NOT first AND NOT second) AS uncovered, coalesce(string_agg(CASE WHEN NOT first AND NOT second THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos), '') AS ids FROM b GROUP BY page_id""",
)
def plan_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a plan leaves out are asked for once more; what then is still left out is reported."""
    texts = rich(spark, sf_dir).where("type = 'text'").select(*KEY)
    first, second = texts.where("pos % 3 <> 0"), texts.where("pos % 9 <> 0")
    again = texts.join(first, KEY, "left_anti")
    left = again.join(second, KEY, "left_anti").withColumn("left", F.lit(True))
    both = again.join(left, KEY, "left").groupBy("page_id").agg(F.count("*").alias("asked_again"), F.count("left").alias("uncovered"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("left"), F.col("pos")))), ",").alias("ids"))
    zero = texts.select("page_id").distinct().join(both, "page_id", "left")
    return zero.select("page_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("asked_again", "uncovered")), F.coalesce("ids", F.lit("")).alias("ids"))


# a setting comes from the environment, else a file, else the default; one that isn't a number is the default
_ENV, _FILE = "CASE event_id % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'many' WHEN 2 THEN '' WHEN 3 THEN CAST(event_id % 97 AS VARCHAR) END", "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 31 AS VARCHAR) WHEN event_id % 3 = 1 THEN '7x' END"
_SETTING = lambda cast: f"coalesce({cast}(trim(coalesce(nullif({_ENV}, ''), {_FILE})) AS INT), 25)"
add("src11_configuration", lambda s, d: table(s, d, "events").selectExpr("event_id", _SETTING("try_cast").replace("VARCHAR", "STRING") + " AS megabytes"), f"SELECT event_id, {_SETTING('TRY_CAST')} AS megabytes FROM events")
_ENGINE = ("element_id % 3 <> 0", "element_id % 6 <> 1", "element_id % 4 <> 2")
add("src12_engines", lambda s, d: elements(s, d).groupBy("page_id").agg(F.expr(f"count_if({_ENGINE[0]})").alias("installed"), F.expr(f"count_if({_ENGINE[0]} AND {_ENGINE[1]})").alias("initialised"), F.expr(f"min(CASE WHEN {' AND '.join(_ENGINE)} THEN element_id END)").alias("active")), f"WITH {ELEMENTS} SELECT page_id, count_if({_ENGINE[0]}) AS installed, count_if({_ENGINE[0]} AND {_ENGINE[1]}) AS initialised, min(CASE WHEN {' AND '.join(_ENGINE)} THEN element_id END) AS active FROM e GROUP BY page_id")
# The images that may be uploaded, and their types.
UPLOADS = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}
_UPLOAD = "CASE pos % 7 WHEN 0 THEN 'A b.PNG' WHEN 1 THEN 'x.gif' WHEN 2 THEN 'y.jpeg' WHEN 3 THEN 'noend' WHEN 4 THEN 'z.webp' WHEN 5 THEN 'archive.tar.png' ELSE 'w.JPG' END"


@query(
    "src01_image_upload",
    f"""WITH {ELEMENTS}, u AS (SELECT page_id, pos, {_UPLOAD} AS name, md5(CAST(element_id AS VARCHAR)) AS id FROM e), k AS (SELECT *, lower(regexp_extract(name, '\\.[^.]+$')) AS suffix FROM u)
    SELECT page_id, pos, name, CASE WHEN suffix IN {tuple(UPLOADS)!r} THEN 201 ELSE 415 END AS status, CASE WHEN suffix IN {tuple(UPLOADS)!r} THEN 'uploads/' || id || suffix END AS path, {of(UPLOADS, 'suffix', 'NULL')} AS content_type FROM k""",
)
def image_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that each upload makes: a name of its own with the old ending, or 415 for what isn't an image that may be uploaded."""
    u = elements(spark, sf_dir).select(*KEY, F.expr(_UPLOAD).alias("name"), F.md5(F.col("element_id").cast("string")).alias("id")).withColumn("suffix", F.lower(F.regexp_extract("name", "\\.[^.]+$", 0)))
    fine = F.col("suffix").isin(*UPLOADS)
    return u.select(*KEY, "name", F.when(fine, 201).otherwise(415).alias("status"), F.when(fine, F.concat(F.lit("uploads/"), "id", "suffix")).alias("path"), S.lookup(F.col("suffix"), UPLOADS).alias("content_type"))


@query("snk01_store_write", f"WITH {ELEMENTS} SELECT page_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS at FROM e GROUP BY page_id")
def store_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through files: each page a folder of JSON that is complete or not there."""
    from ..session import new_folder

    at = new_folder(spark, "pages")
    rows = F.sort_array(F.collect_list(F.struct("pos", "type")))
    store.write_folders(spread(elements(spark, sf_dir), "page_id").groupBy("page_id").agg(F.to_json(rows).alias("document")), at)
    found = store.read_folders(spark, at).select("page_id", F.explode(F.from_json("document", "array<struct<pos:int,type:string>>")).alias("e"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("e.pos").alias("at"))


# payloads, as text; both sides parse what the same rule writes
_ARRAY = """CASE event_id % 7 WHEN 0 THEN '[{"id":"a"},{"id":"b","role":"x"}]' WHEN 1 THEN NULL WHEN 2 THEN '{"id":"e' || user_id || '","type":"t"}' WHEN 3 THEN '{"k' || user_id || '":{"w":1},"m":{"id":"own"}}'
  WHEN 4 THEN '{}' WHEN 5 THEN '"word"' ELSE '{"w":' || user_id || '}' END"""


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as it is; nothing for null, an empty or a useless object and a plain value; an object with a name as the only item; a map of objects as items with their keys as ids."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_ARRAY).alias("raw"))
    listed, object_ = F.from_json("raw", "array<string>"), F.from_json("raw", "map<string,string>")
    ids = lambda items: F.transform(items, lambda x: F.get_json_object(x, "$.id"))
    named = F.exists(F.map_keys("o"), lambda k: k.isin("id", "ocrId", "name", "type", "role"))
    inner = F.transform(F.map_entries("o"), lambda kv: F.coalesce(F.get_json_object(kv["value"], "$.id"), kv["key"]))
    objects = F.forall(F.map_values("o"), lambda v: v.startswith("{"))
    made = F.when(F.col("raw").startswith("["), ids(F.col("l"))).when(~F.coalesce(F.col("raw"), F.lit("")).startswith("{") | (F.size("o") == 0), F.array().cast("array<string>")).when(named, F.array(F.get_json_object("raw", "$.id"))).when(objects, inner).otherwise(F.array().cast("array<string>"))
    typed = e.withColumns({"l": F.when(F.col("raw").startswith("["), listed), "o": F.when(F.col("raw").startswith("{"), object_)})
    return typed.select("event_id", F.size(made).cast("long").alias("n"), F.array_join(made, ",").alias("ids"))


add(
    "sca35_coerce_array",
    coerced,
    f"""WITH r AS (SELECT event_id, {_ARRAY} AS raw FROM events), t AS (SELECT *, json_type(raw) AS kind FROM r), k AS (SELECT *, CASE WHEN kind = 'OBJECT' THEN json_keys(raw) ELSE [] END AS keys FROM t),
    v AS (SELECT event_id, CASE WHEN kind = 'ARRAY' THEN [json_extract_string(x, '$.id') FOR x IN CAST(raw AS JSON[])] WHEN len(keys) = 0 THEN [] WHEN len([x FOR x IN keys IF x IN ('id', 'ocrId', 'name', 'type', 'role')]) > 0 THEN [json_extract_string(raw, '$.id')]
      WHEN len([x FOR x IN keys IF json_type(raw, '$.' || x) <> 'OBJECT']) = 0 THEN [coalesce(json_extract_string(raw, '$.' || x || '.id'), x) FOR x IN keys] ELSE [] END AS ids FROM k)
    SELECT event_id, CAST(len(ids) AS BIGINT) AS n, array_to_string(ids, ',') AS ids FROM v""",
)
# Strategies of a plan's modules by other names, and those that count.
MODULE_ALIAS = {"hybrid": "mixed_component", "image": "movable_image", "local_image": "movable_image", "transparent_image": "movable_image", "shape": "native_shape", "text": "editable_text", "background_image": "background"}
MODULE_STRATEGIES = ("editable", "whole_image", "hybrid", "editable_text", "native_shape", "movable_image", "cutout_image", "mixed_component", "background", "ignore")
_SAID = "string_split('hybrid,image,text,editable,odd,shape,,cutout_image,background_image', ',')[CAST(event_id % 9 + 1 AS INT)]"
_CLEAN = of(MODULE_ALIAS, "said", "said")


@query(
    "sca37_scene_payload",
    f"""WITH m AS (SELECT event_id // 60 AS scene, event_id, {_SAID} AS said, event_id % 11 = 0 AS broken, row_number() OVER (PARTITION BY event_id // 60 ORDER BY event_id) AS nth FROM events),
    c AS (SELECT *, CASE WHEN said = '' THEN 'editable' WHEN {_CLEAN} IN {MODULE_STRATEGIES!r} THEN {_CLEAN} ELSE 'editable' END AS strategy FROM m WHERE nth <= 40)
    SELECT scene, count_if(NOT broken) AS kept, count_if(broken) AS dropped, count_if(NOT broken AND said <> '' AND strategy <> said) AS warnings, string_agg(CASE WHEN NOT broken THEN strategy END, ',' ORDER BY event_id) AS strategies FROM c GROUP BY scene""",
)
def scene_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a scene's modules the first forty, each with a strategy that counts; broken ones are dropped alone, what was changed is counted."""
    said = F.element_at(F.split(F.lit("hybrid,image,text,editable,odd,shape,,cutout_image,background_image"), ","), (F.col("event_id") % 9 + 1).cast("int"))
    m = table(spark, sf_dir, "events").select(F.expr("event_id div 60").alias("scene"), "event_id", said.alias("said"), (F.col("event_id") % 11 == 0).alias("broken"))
    m = m.withColumn("nth", F.row_number().over(Window.partitionBy("scene").orderBy("event_id"))).where("nth <= 40")
    clean = S.lookup(F.col("said"), MODULE_ALIAS, F.col("said"))
    c = m.withColumn("strategy", F.when((F.col("said") == "") | ~clean.isin(*MODULE_STRATEGIES), "editable").otherwise(clean))
    ordered = F.transform(F.sort_array(F.collect_list(F.when(~F.col("broken"), F.struct("event_id", "strategy")))), lambda x: x["strategy"])
    return c.groupBy("scene").agg(F.count_if(~F.col("broken")).alias("kept"), F.count_if("broken").alias("dropped"), F.count_if(~F.col("broken") & (F.col("said") != "") & (F.col("strategy") != F.col("said"))).alias("warnings"), F.array_join(ordered, ",").alias("strategies"))


_CRITIC = """'{"issues":[{"' || CASE WHEN event_id % 3 = 0 THEN 'element_id' ELSE 'elementId' END || '":' || CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) ELSE '"e' || user_id || '"' END || ',"oldTextGhosting":' || CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' WHEN 2 THEN '0' WHEN 3 THEN '"No"' ELSE '"1"' END || '}],"overallAssessment":{"layout":' || CASE event_id % 3 WHEN 0 THEN '"high"' WHEN 1 THEN '"87%"' ELSE '0.4' END || '}}'"""


def critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A critic's first issue: its element by either name, as text; a yes or no in any spelling; the assessment as a share."""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_CRITIC.replace("VARCHAR", "STRING")).alias("raw"))
    at = lambda p: F.get_json_object("raw", p)
    return raw.select("event_id", F.coalesce(at("$.issues[0].elementId"), at("$.issues[0].element_id")).alias("element"), F.lower(at("$.issues[0].oldTextGhosting")).isin("true", "yes", "1").alias("ghost"), S.probability(at("$.overallAssessment.layout"), 0.0).alias("layout"))


add(
    "sca39_critic_payload",
    critic,
    f"""WITH r AS (SELECT event_id, {_CRITIC} AS raw FROM events), t AS (SELECT event_id, raw, json_extract_string(raw, '$.overallAssessment.layout') AS said FROM r)
    SELECT event_id, coalesce(json_extract_string(raw, '$.issues[0].elementId'), json_extract_string(raw, '$.issues[0].element_id')) AS element, lower(json_extract_string(raw, '$.issues[0].oldTextGhosting')) IN ('true', 'yes', '1') AS ghost,
      CASE WHEN said = 'high' THEN 0.9 WHEN said LIKE '%\\%' ESCAPE '\\' THEN CAST(left(said, len(said) - 1) AS DOUBLE) / 100 ELSE CAST(said AS DOUBLE) END AS layout FROM t""",
)
_MODULE = """'{' || CASE event_id % 3 WHEN 0 THEN '"id":"m' || event_id || '"' WHEN 1 THEN '"moduleId":"n' || event_id || '"' ELSE '"id":"i' || user_id || '","moduleId":"k"' END || ',"bbox":' || CASE event_id % 4 WHEN 0 THEN '[1,2.5,' || (user_id % 90) || ',40.25]' WHEN 1 THEN '{"left":3,"top":4,"width":50,"height":6.5}' WHEN 2 THEN '"none"' ELSE '[1,2,3]' END
  || ',"visualComplexity":' || CASE event_id % 7 WHEN 0 THEN '"High"' WHEN 1 THEN '2' WHEN 2 THEN '0.4' WHEN 3 THEN '"x"' WHEN 4 THEN '7' WHEN 5 THEN 'null' ELSE '-1' END || ',"strategy":' || CASE event_id % 5 WHEN 0 THEN '"image"' WHEN 1 THEN '"odd"' WHEN 2 THEN 'null' WHEN 3 THEN '"hybrid"' ELSE '"cutout_image"' END || '}'"""
_SCORES = {"low": 0.2, "medium": 0.5, "high": 0.8}


def scene_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the first forty modules of a scene's plan: its id by either name, its box from four edges or four fields, its score from a word or a number, and a strategy that counts; one without a box is dropped alone."""
    raw = table(spark, sf_dir, "events").select(F.expr("event_id div 60").alias("scene"), "event_id", F.expr(_MODULE.replace("VARCHAR", "STRING")).alias("raw"))
    m = raw.withColumn("nth", F.row_number().over(Window.partitionBy("scene").orderBy("event_id"))).where("nth <= 40")
    at = lambda name: F.get_json_object("raw", f"$.{name}")
    edges, fields = F.from_json(at("bbox"), "array<double>"), F.from_json(at("bbox"), "left double, top double, width double, height double")
    from_edges = F.when(at("bbox").startswith("[") & (F.size(edges) == 4), F.struct(F.get(edges, F.lit(0)).alias("left"), F.get(edges, F.lit(1)).alias("top"), F.round(F.get(edges, F.lit(2)) - F.get(edges, F.lit(0)), 6).alias("width"), F.round(F.get(edges, F.lit(3)) - F.get(edges, F.lit(1)), 6).alias("height")))
    box = F.coalesce(from_edges, F.when(at("bbox").startswith("{"), fields))
    number = at("visualComplexity").try_cast("double")
    share = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((number > 1) & (number <= 3), number / 3).otherwise(number))))
    score = F.coalesce(S.lookup(F.lower(at("visualComplexity")), _SCORES, F.lit(None).cast("double")), share, F.lit(0.5))
    named = S.lookup(at("strategy"), MODULE_ALIAS, at("strategy"))
    return m.withColumn("box", box).where("box IS NOT NULL").select("scene", "event_id", F.coalesce(at("id"), at("moduleId")).alias("id"), "box.*", F.round(score, 6).alias("complexity"), F.when(named.isin(*MODULE_STRATEGIES), named).otherwise("editable").alias("strategy"))


_NAMED = of(MODULE_ALIAS, "said", "said")
add(
    "sca37_scene_modules",
    scene_modules,
    f"""WITH r AS (SELECT event_id // 60 AS scene, event_id, {_MODULE} AS raw, row_number() OVER (PARTITION BY event_id // 60 ORDER BY event_id) AS nth FROM events),
    j AS (SELECT scene, event_id, coalesce(json_extract_string(raw, '$.id'), json_extract_string(raw, '$.moduleId')) AS id, json_extract(raw, '$.bbox') AS b, lower(json_extract_string(raw, '$.visualComplexity')) AS c, json_extract_string(raw, '$.strategy') AS said FROM r WHERE nth <= 40),
    k AS (SELECT *, json_type(b) = 'ARRAY' AND json_array_length(b) = 4 AS four, TRY_CAST(c AS DOUBLE) AS n FROM j)
    SELECT scene, event_id, id, CASE WHEN four THEN CAST(b[0] AS DOUBLE) ELSE CAST(json_extract(b, '$.left') AS DOUBLE) END AS "left", CASE WHEN four THEN CAST(b[1] AS DOUBLE) ELSE CAST(json_extract(b, '$.top') AS DOUBLE) END AS top,
      CASE WHEN four THEN round(CAST(b[2] AS DOUBLE) - CAST(b[0] AS DOUBLE), 6) ELSE CAST(json_extract(b, '$.width') AS DOUBLE) END AS width, CASE WHEN four THEN round(CAST(b[3] AS DOUBLE) - CAST(b[1] AS DOUBLE), 6) ELSE CAST(json_extract(b, '$.height') AS DOUBLE) END AS height,
      round(CASE c WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.8 ELSE CASE WHEN n IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, CASE WHEN n > 1 AND n <= 3 THEN n / 3 ELSE n END)) END END::DOUBLE, 6) AS complexity, CASE WHEN {_NAMED} IN {MODULE_STRATEGIES!r} THEN {_NAMED} ELSE 'editable' END AS strategy
    FROM k WHERE four OR json_type(b) = 'OBJECT'""",
)
_ISSUES = """'{"issues":[' || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{"elementId":"a' || user_id || '","problem":"p0"}' WHEN 2 THEN '7,{"element_id":' || user_id || ',"oldTextGhosting":"Yes"}' WHEN 3 THEN '{"elementId":"","element_id":"b","oldTextGhosting":0},null,{"problem":"p1","oldTextGhosting":true},"x"' ELSE '{"elementId":"c","element_id":"d","oldTextGhosting":"off"},{"elementId":"e' || event_id || '","oldTextGhosting":"1"},[1]' END || ']}'"""


def critic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of a critic's payload, numbered as it is kept: what isn't an object is dropped, the element by either name, a yes or no in any spelling if there is one."""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_ISSUES.replace("VARCHAR", "STRING")).alias("raw"))
    kept = F.filter(F.from_json("raw", "issues array<string>")["issues"], lambda x: x.startswith("{"))
    rows = raw.select("event_id", F.posexplode(kept).alias("nth", "issue"))
    at = lambda name: F.get_json_object("issue", f"$.{name}")
    return rows.select("event_id", "nth", F.coalesce(F.nullif(at("elementId"), F.lit("")), at("element_id")).alias("element"), at("problem").alias("problem"), F.lower(at("oldTextGhosting")).isin("true", "yes", "1").alias("ghost"))


add(
    "sca39_critic_issues",
    critic_issues,
    f"""WITH r AS (SELECT event_id, json_extract({_ISSUES}, '$.issues[*]') AS xs FROM events),
    k AS (SELECT event_id, [x FOR x IN xs IF json_type(x) = 'OBJECT'] AS xs FROM r), u AS (SELECT event_id, CAST(n AS INTEGER) AS nth, xs[n + 1] AS x FROM (SELECT event_id, xs, unnest(range(0, len(xs))) AS n FROM k))
    SELECT event_id, nth, coalesce(nullif(json_extract_string(x, '$.elementId'), ''), json_extract_string(x, '$.element_id')) AS element, json_extract_string(x, '$.problem') AS problem, lower(json_extract_string(x, '$.oldTextGhosting')) IN ('true', 'yes', '1') AS ghost FROM u""",
)
_ELEMENT = """'{"id":"e' || event_id || '","confidence":' || CASE event_id % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '1.7' WHEN 2 THEN '"x"' ELSE '1' END || ',"role":' || CASE event_id % 3 WHEN 0 THEN '"title"' WHEN 1 THEN '7' ELSE '"label"' END || CASE WHEN event_id % 6 = 0 THEN ',"ocrId":"o' || user_id || '"' ELSE '' END || '}'"""


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element whose fields aren't valid keeps its ids and takes the defaults; none is dropped."""
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(_ELEMENT.replace("VARCHAR", "STRING")).alias("raw"))
    e = F.from_json("raw", "id string, ocrId string, confidence string, role string")
    sure = e["confidence"].try_cast("double")
    valid = F.coalesce(sure.between(0, 1), F.lit(False)) & ~e["role"].rlike("^\\d+$")
    return raw.select("event_id", e["id"].alias("id"), e["ocrId"].alias("ocr_id"), F.when(valid, sure).otherwise(0.5).alias("confidence"), F.when(valid, e["role"]).alias("role"), valid.alias("valid"))


add(
    "sca40_validate",
    validated,
    f"""WITH r AS (SELECT event_id, {_ELEMENT} AS raw FROM events), t AS (SELECT event_id, json_extract_string(raw, '$.id') AS id, json_extract_string(raw, '$.ocrId') AS ocr_id, json_extract_string(raw, '$.role') AS role, TRY_CAST(json_extract_string(raw, '$.confidence') AS DOUBLE) AS c, json_type(raw, '$.role') = 'VARCHAR' AS named FROM r),
    v AS (SELECT *, coalesce(c BETWEEN 0 AND 1, false) AND named AS valid FROM t) SELECT event_id, id, ocr_id, CASE WHEN valid THEN c ELSE 0.5 END AS confidence, CASE WHEN valid THEN role END AS role, valid FROM v""",
)
_FAULT = {"status": "string_split('401,403,404,429,400,500,503,0,0,0,0,418', ',')[CAST(event_id % 12 + 1 AS INT)]::INT", "body": "CASE event_id % 5 WHEN 0 THEN 'insufficient_quota' WHEN 1 THEN 'SSL certificate' WHEN 2 THEN 'Read timed out' WHEN 3 THEN 'connection reset' ELSE CASE event_id % 2 WHEN 0 THEN 'Arrearage' ELSE '余额不足' END END"}


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(x) for x in (401, 403, 404, 429, 400, 500, 503, 0, 0, 0, 0, 418))), (F.col("event_id") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", status.alias("status"), F.expr(_FAULT["body"]).alias("body"))


_FAULTS = f"f AS (SELECT event_id, user_id, {_FAULT['status']} AS status, {_FAULT['body']} AS body FROM events)"


def fault_class(status: Column, body: Column) -> Column:
    """stage:type of a failed call, by its status and else by what it says."""
    low = F.lower(body)
    return (
        F.when(status == 401, "auth:authentication_error").when(status == 403, "auth:permission_denied").when(status == 404, "model:model_not_found")
        .when(status == 429, F.when(low.rlike("quota|余额"), "request:insufficient_quota").otherwise("request:rate_limit"))
        .when(status == 400, F.when(low.contains("arrearage") | low.contains("account balance"), "request:insufficient_quota").otherwise("request:invalid_request"))
        .when(status >= 500, "request:server_error").when(low.rlike("ssl|tls|certificate"), "network:tls_error").when(low.rlike("timeout|timed out|deadline"), "network:connection_timeout")
        .when(low.rlike("connect|network"), "network:connect_error").otherwise("request:request_error")
    )


_CLASS = """CASE WHEN status = 401 THEN 'auth:authentication_error' WHEN status = 403 THEN 'auth:permission_denied' WHEN status = 404 THEN 'model:model_not_found' WHEN status = 429 AND regexp_matches(lower(body), 'quota|余额') THEN 'request:insufficient_quota' WHEN status = 429 THEN 'request:rate_limit'
  WHEN status = 400 AND (contains(lower(body), 'arrearage') OR contains(lower(body), 'account balance')) THEN 'request:insufficient_quota' WHEN status = 400 THEN 'request:invalid_request' WHEN status >= 500 THEN 'request:server_error' WHEN regexp_matches(lower(body), 'ssl|tls|certificate') THEN 'network:tls_error'
  WHEN regexp_matches(lower(body), 'timeout|timed out|deadline') THEN 'network:connection_timeout' WHEN regexp_matches(lower(body), 'connect|network') THEN 'network:connect_error' ELSE 'request:request_error' END"""
add("sca41_error_class", lambda s, d: faults(s, d).select("event_id", fault_class(F.col("status"), F.col("body")).alias("kind")), f"WITH {_FAULTS} SELECT event_id, {_CLASS} AS kind FROM f")
_TELL = {"auth": "The key was refused", "model": "The model isn't there", "network": "The service can't be reached", "request": "The request failed"}
add(
    "sca46_error_text",
    lambda s, d: faults(s, d).select("event_id", F.concat(S.lookup(F.split(fault_class(F.col("status"), F.col("body")), ":")[0], _TELL), F.lit(": "), S.redact(F.concat_ws("; ", F.concat(F.lit("api_key="), F.md5(F.col("user_id").cast("string"))), F.when(F.col("status") > 0, F.concat(F.lit("HTTP "), F.col("status").cast("string"))), "body"))).alias("said")),
    f"WITH {_FAULTS} SELECT event_id, " + of(_TELL, f"split_part({_CLASS}, ':', 1)", "NULL").replace("isn't", "isn''t").replace("can't", "can''t") + " || ': ' || concat_ws('; ', 'api_key=***', CASE WHEN status > 0 THEN 'HTTP ' || status END, body) AS said FROM f",
)
_SUFFIX = "CASE doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' ELSE '.bin' END"
add(
    "sca49_data_url",
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(S.data_url(F.encode(F.col("text"), "UTF-8"), F.concat(F.lit("x"), F.expr(_SUFFIX)))).alias("url")),
    f"SELECT doc_id, md5('data:' || CASE lower({_SUFFIX}) WHEN '.png' THEN 'image/png' WHEN '.jpg' THEN 'image/jpeg' WHEN '.webp' THEN 'image/webp' ELSE 'application/octet-stream' END || ';base64,' || to_base64(encode(text))) AS url FROM documents",
)
_URL = "'https://h' || user_id || '.example/v' || (event_id % 3) || CASE event_id % 4 WHEN 0 THEN '/chat/completions' WHEN 1 THEN '/models/' WHEN 2 THEN '//' ELSE '' END"
add("sca29_base_url", lambda s, d: table(s, d, "events").select("event_id", F.regexp_replace(F.expr(_URL), "/(chat/completions|models)?/*$", "").alias("url")), "SELECT event_id, 'https://h' || user_id || '.example/v' || (event_id % 3) AS url FROM events")
_CHAT = """CASE event_id % 3 WHEN 0 THEN '```json
{"k": ' || user_id || ', "in": {"a": 1}}
```' WHEN 1 THEN 'So: {"k": ' || (user_id + 1) || '} as asked.' ELSE '{"k": 5}' END"""
add("sca30_outer_json", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(S.outer_json(F.expr(_CHAT)), "$.k").cast("long").alias("k")), f"WITH r AS (SELECT event_id, {_CHAT} AS raw FROM events) SELECT event_id, CAST(json_extract_string(regexp_extract(raw, '\\{{[\\s\\S]*\\}}'), '$.k') AS BIGINT) AS k FROM r")
add(
    "sca27_redact",
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(S.redact(F.concat(F.lit("api_key=abc123, Bearer a.b-c sk-abcdefgh password: hunter2 "), F.col("text")))).alias("said")),
    r"SELECT doc_id, md5(left('api_key=***, Bearer *** sk-*** password: *** ' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(bearer\s+)[A-Za-z0-9._-]+', '\1***', 'g'), '(?i)(api[_-]?key\s*[=:]\s*)[^\s,;]+', '\1***', 'g'), 'sk-[A-Za-z0-9]{6,}', 'sk-***', 'g'), '(?i)(password\s*[=:]\s*)[^\s,;]+', '\1***', 'g'), 1000)) AS said FROM documents",
)
_NESTED = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'sk-a***' WHEN 2 THEN 'new' || user_id END"


def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat settings as nested ones; a secret stays what it was where the new one is empty or masked."""
    new, old = F.expr(_NESTED), F.concat(F.lit("old"), F.col("event_id").cast("string"))
    secret = F.when(new.isNull() | (new == "") | new.contains("***"), old).otherwise(new)
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.struct(secret.alias("apiKey"), F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("default")).alias("model")).alias("vision"))).alias("settings"))


add("sta10_settings_merge", migrated, f"""WITH n AS (SELECT event_id, event_type, {_NESTED} AS new FROM events) SELECT event_id, '{{"vision":{{"apiKey":"' || CASE WHEN new IS NULL OR new = '' OR contains(new, '***') THEN 'old' || event_id ELSE new END || '","model":"' || CASE WHEN event_type <> 'view' THEN event_type ELSE 'default' END || '"}}}}' AS settings FROM n""")
add(
    "snk06_localised_name",
    lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("../"), "source")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("a/"), "source")).otherwise(F.col("source")).alias("name"), "text").where(~F.col("name").rlike("\\.\\.|^/|[/\\\\]")).select("doc_id", store.localised_name(F.concat("name", F.lit(".png")), F.col("text").cast("binary")).alias("name")),
    "SELECT doc_id, source || '_' || left(sha256(text), 12) || '.png' AS name FROM documents WHERE doc_id % 4 >= 2",
)
_KEPT = "k AS (SELECT DISTINCT type || '_' || (pos % 10) || '.png' AS name FROM e WHERE element_id % 3 = 0 AND pos % 10 <> 7)"


@query("snk07_repaired_urls", f"WITH {ELEMENTS}, {_KEPT}, s AS (SELECT page_id, pos, type || '_' || (pos % 10) || '.png' AS name FROM e) SELECT page_id, pos, CASE WHEN k.name IS NOT NULL THEN '/media/assets/' || s.name ELSE '/media/assets/revisions/' || s.name || '?v=2' END AS src FROM s LEFT JOIN k ON s.name = k.name")
def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of revisions lead to the original where the inventory still has it, and stay otherwise."""
    e = elements(spark, sf_dir)
    name = F.concat("type", F.lit("_"), (F.col("pos") % 10).cast("string"), F.lit(".png"))
    kept = e.where("element_id % 3 = 0 AND pos % 10 <> 7").select(name.alias("name")).distinct().withColumn("url", F.concat(F.lit("/media/assets/"), "name"))
    return store.repaired_urls(e.select(*KEY, F.concat(F.lit("/media/assets/revisions/"), name, F.lit("?v=2")).alias("src")), kept)


add(
    "snk04_report_rows",
    lambda s, d: elements(s, d).groupBy("page_id", "type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean")).select(F.concat("type", F.lit("_report"), F.when(F.col("page_id") > 0, F.concat(F.lit("_"), (F.col("page_id") + 1).cast("string"))).otherwise(""), F.lit(".json")).alias("file"), F.to_json(F.struct("page_id", "n")).alias("value")),
    f"""WITH {ELEMENTS} SELECT type || '_report' || CASE WHEN page_id > 0 THEN '_' || (page_id + 1) ELSE '' END || '.json' AS file, '{{"page_id":' || page_id || ',"n":' || count(*) || '}}' AS value FROM e GROUP BY page_id, type""",
)
add("sta08_accept_result", lambda s, d: elements(s, d).groupBy("page_id").agg(F.count_if("suppressed").alias("bad"), F.max("z_index").alias("z")).select("page_id", F.when(F.col("bad") <= 3, "user_accepted").when(F.col("z") > 24, "stagnated").otherwise("proposed").alias("status")), f"WITH {ELEMENTS} SELECT page_id, CASE WHEN count_if(suppressed) <= 3 THEN 'user_accepted' WHEN max(z_index) > 24 THEN 'stagnated' ELSE 'proposed' END AS status FROM e GROUP BY page_id")

# providers: the first that is ready does the work, in Arrow batches on the executors
_TAKE = ["missing", "none", "words", "mean", "types", "halves", "boxes", "spaces"]
add("udf01_ocr_provider", lambda s, d: P.OCR.apply(ocr_lines(s, d).where("text <> ''").select(*KEY, "text", "x1"), _TAKE), f"WITH {OCR_LINES}, w AS (SELECT page_id, pos, x1, string_split(text, ' ') AS ws FROM o WHERE text <> ''), k AS (SELECT *, unnest(range(0, len(ws))) AS nth FROM w) SELECT page_id, pos, CAST(nth AS INT) AS nth, ws[nth + 1] AS word, x1 + 9.0 * nth AS x1, 0.8 AS confidence FROM k WHERE ws[nth + 1] <> ''")
add("udf02_inpainting_provider", lambda s, d: P.INPAINTING.apply(pixels(s, d).groupBy("page_id").agg(F.sum("v").alias("total"), F.count("*").alias("n")), _TAKE), f"WITH {PIXELS} SELECT page_id, CAST(sum(v) AS DOUBLE) / count(*) AS v FROM px GROUP BY page_id")
add("udf03_vision_provider", lambda s, d: P.VISION.apply(elements(s, d).select(*KEY, "type", "confidence"), _TAKE), f"WITH {ELEMENTS} SELECT page_id, pos, 'a ' || type AS label, CASE WHEN type <> 'line' THEN confidence ELSE 0.5 END AS confidence FROM e")
add("udf04_layout_provider", lambda s, d: P.LAYOUT.apply(elements(s, d).select(*KEY, "x1", "x2"), _TAKE), f"WITH {ELEMENTS} SELECT page_id, pos, CASE WHEN (x1 + x2) / 2 < 480 THEN 'left' ELSE 'right' END AS region FROM e")
add("udf05_segmentation_provider", lambda s, d: P.SEGMENTS.apply(elements(s, d).select(*KEY, "x1", "y1", "x2", "y2"), _TAKE), f"WITH {ELEMENTS} SELECT page_id, pos, (x2 - x1) * (y2 - y1) AS area FROM e")
add("udf06_text_cleaner", lambda s, d: P.CLEANERS.apply(elements(s, d).where("type = 'text'").select(*KEY, F.concat(F.lit("  "), "text", F.lit(" ")).alias("text")), _TAKE), f"WITH {ELEMENTS} SELECT page_id, pos, upper(text) AS text FROM e WHERE type = 'text'")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of one's own, with a factory in the place of a class."""
    own = P.Registry("vision model")
    own.add("first", P.Missing)
    own.add("second", lambda: P.TypeVision())
    return own.apply(elements(spark, sf_dir).where("type = 'image'").select(*KEY, "type", "confidence"), ["first", "second"])


add("udf07_injected_factory", injected, f"WITH {ELEMENTS} SELECT page_id, pos, 'a image' AS label, confidence FROM e WHERE type = 'image'")
#: Which kind of engine looks at an element of a type.
_ENGINE_OF = {"text": P.OCR, "image": P.VISION, "rectangle": P.SEGMENTS, "ellipse": P.LAYOUT, "line": P.INPAINTING}
_NAME_OF = {"text": ("recogniser", "words"), "image": ("vision model", "types"), "rectangle": ("segment finder", "boxes"), "ellipse": ("layout finder", "halves"), "line": ("painter", "mean")}


def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each element the kind of engine that looks at it, and the first engine of that kind that is ready."""
    kinds = {t: r.kind for t, r in _ENGINE_OF.items()}
    chosen = {t: r.take(_TAKE)[0] for t, r in _ENGINE_OF.items()}
    return elements(spark, sf_dir).select(*KEY, S.lookup(F.col("type"), kinds).alias("kind"), S.lookup(F.col("type"), chosen).alias("chosen"))


add("udf08_provider_choice", provider_choice, f"WITH {ELEMENTS} SELECT page_id, pos, CASE type " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, (k, _) in _NAME_OF.items()) + " END AS kind, CASE type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, (_, c) in _NAME_OF.items()) + " END AS chosen FROM e")

"""Queries of the text, colour, number and payload functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.views import ELEMENTS, OCR_LINES, PAYLOADS, elements, ocr_lines, payloads, table
from .registry import columns


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def case(value: str, values: dict, default: str = "NULL") -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {default} END"


def doc(name, made, sql) -> None:
    columns(name, documents, ["doc_id"], made, "d AS (SELECT * FROM documents)", "d", sql)


def ocr(name, made, sql) -> None:
    columns(name, ocr_lines, ["page_id", "pos"], made, OCR_LINES, "o", sql)


def ele(name, made, sql) -> None:
    columns(name, elements, ["page_id", "pos"], made, ELEMENTS, "e", sql)


def pay(name, made, sql) -> None:
    columns(name, payloads, ["event_id"], made, PAYLOADS, "k", sql)


T, SIZE = (lambda: F.col("text")), (lambda: F.col("y2") - F.col("y1"))
RED, GREEN, BLUE = (lambda: F.pmod(F.col("element_id") * 37, F.lit(256)).cast("int")), (lambda: F.pmod(F.col("element_id") * 91, F.lit(256)).cast("int")), (lambda: F.pmod(F.col("element_id") * 13, F.lit(256)).cast("int"))
RGB, RGB2 = (lambda: (RED(), GREEN(), BLUE())), (lambda: (GREEN(), BLUE(), RED()))
R, G, B = "CAST(element_id * 37 % 256 AS INT)", "CAST(element_id * 91 % 256 AS INT)", "CAST(element_id * 13 % 256 AS INT)"
HEX = f"printf('#%02X%02X%02X', {R}, {G}, {B})"
BLANK = "[ \\t\\n\\r\\f\\x0b\\x{85}\\p{Z}]"

doc("sca01_duplicate_key", lambda: {"key": F.md5(S.duplicate_key(T()))}, {"key": f"CASE WHEN length(regexp_replace(text, '{BLANK}+', '', 'g')) >= 2 THEN md5(replace(lower(regexp_replace(text, '{BLANK}+', '', 'g')), 'ß', 'ss')) END"})
doc("sca02_strip_key", lambda: {"key": F.md5(S.fold_case(S.strip(F.concat(F.lit(" 　"), T(), F.lit("\t")))))}, {"key": f"md5(replace(lower(regexp_replace(chr(32) || chr(12288) || text || chr(9), '^{BLANK}+|{BLANK}+$', '', 'g')), 'ß', 'ss'))"})
doc("sca03_cjk", lambda: {"n": S.n_cjk(F.concat(T(), F.lit("版面ab"))).cast("long"), "has": T().rlike("[㐀-鿿]")}, {"n": "CAST(len(regexp_extract_all(text || '版面ab', '[㐀-鿿]')) AS BIGINT)", "has": "regexp_matches(text, '[㐀-鿿]')"})
ocr("sca04_line_width", lambda: {"width": S.line_width(F.concat(T(), F.lit("版")), F.lit(12.0))}, {"width": "1 * 12.0 + length(text) * 12.0 * 0.56"})
ocr("sca05_fit_textbox", lambda: {"size": S.fit_size(T(), SIZE(), (F.col("x2") - F.col("x1")) * 4)}, {"size": "greatest(5.0, coalesce(list_extract([s FOR s IN [(y2 - y1) * pow(0.98, CAST(k AS DOUBLE)) FOR k IN range(0, 12)] IF length(text) * s * 0.56 <= (x2 - x1) * 4 OR s <= (y2 - y1) * 0.8], 1), (y2 - y1) * 0.8))"})
ocr("sca07_font_size", lambda: {"size": F.round(S.font_size(T(), F.col("role"), F.col("x2") - F.col("x1"), SIZE()) + 1e-9, 1)}, {"size": f"round(least(greatest(least((y2 - y1) * {case('role', S.ROLE_FACTORS, '0.82')}::DOUBLE, 0.97::DOUBLE * (x2 - x1) / greatest(length(text) * 1.0 * 0.56::DOUBLE, 1.0)), 7.0), 120.0) + 1e-9, 1)"})
ocr("sca08_text_role", lambda: {"kind": F.when((F.col("y1") < 60) & (SIZE() >= 18), "title").when(F.length("text") < 40, "label").when(F.col("y1") > 480, "footer").otherwise("body")}, {"kind": "CASE WHEN y1 < 60 AND y2 - y1 >= 18 THEN 'title' WHEN length(text) < 40 THEN 'label' WHEN y1 > 480 THEN 'footer' ELSE 'body' END"})
ele("sca09_colourful", lambda: {"yes": F.greatest(*RGB()) - F.least(*RGB()) >= 28}, {"yes": f"greatest({R}, {G}, {B}) - least({R}, {G}, {B}) >= 28"})
ocr("sca10_font_class", lambda: {"kind": S.font_class(T(), F.col("role"))}, {"kind": "CASE WHEN regexp_matches(text, '^[0-9\\s.,%+\\-/:]+$') THEN 'monospace' WHEN role = 'main_title' THEN 'display' WHEN role = 'caption' THEN 'serif' ELSE 'sans' END"})
ele("sca11_first_family", lambda: {"family": S.first_available(["Inter", "Noto Sans", "Arial"], F.when(F.col("pos") % 3 == 0, F.array(F.lit("Arial"), F.lit("Noto Sans"))).when(F.col("pos") % 3 == 1, F.array(F.lit("Arial"))).otherwise(F.array(F.lit("Other"))), "sans-serif")}, {"family": "CASE pos % 3 WHEN 0 THEN 'Noto Sans' WHEN 1 THEN 'Arial' ELSE 'sans-serif' END"})
ocr("sca12_role_policy", lambda: {"weight": S.lookup(F.col("role"), {"main_title": 700, "caption": 400}, F.lit(500)), "spacing": S.lookup(F.col("role"), S.LINE_SPACINGS, F.lit(1.0))}, {"weight": "CASE role WHEN 'main_title' THEN 700 WHEN 'caption' THEN 400 ELSE 500 END", "spacing": case("role", S.LINE_SPACINGS, "1.0")})
ocr("sca13_line_spacing", lambda: {"spacing": F.when(F.length("text") > 120, S.lookup(F.col("role"), S.LINE_SPACINGS, F.lit(1.0))).otherwise(1.0)}, {"spacing": f"CASE WHEN length(text) > 120 THEN {case('role', S.LINE_SPACINGS, '1.0')} ELSE 1.0 END"})
ele("sca14_alignment", lambda: {"side": F.when(F.abs((F.col("x1") + F.col("x2")) / 2 - 480) <= 960 * 0.06, "center").when(F.col("x1") > 960 * 0.6, "right").otherwise("left")}, {"side": "CASE WHEN abs((x1 + x2) / 2 - 480) <= 960 * 0.06 THEN 'center' WHEN x1 > 960 * 0.6 THEN 'right' ELSE 'left' END"})
ocr("sca15_join_texts", lambda: {"joined": F.md5(S.join_texts(T(), F.col("role")))}, {"joined": "md5(CASE WHEN regexp_matches(text, '[A-Za-z0-9]$') AND regexp_matches(role, '^[A-Za-z0-9]') THEN text || ' ' || role ELSE text || role END)"})


def _hexed() -> dict:
    colour = F.when(F.col("pos") % 5 != 0, S.to_hex(*RGB())).otherwise(F.lit("red"))
    return {"hex": colour, **dict(zip("rgb", S.rgb(colour, (17, 24, 39)), strict=True))}


ele("sca16_hex", _hexed, {"hex": f"CASE WHEN pos % 5 <> 0 THEN {HEX} ELSE 'red' END", **{c: f"CASE WHEN pos % 5 <> 0 THEN {v} ELSE {d} END" for c, v, d in (("r", R, 17), ("g", G, 24), ("b", B, 39))}})
ele("sca17_colour_distance", lambda: {"d": S.colour_distance(RGB(), RGB2())}, {"d": f"sqrt(CAST(({R} - {G}) * ({R} - {G}) + ({G} - {B}) * ({G} - {B}) + ({B} - {R}) * ({B} - {R}) AS DOUBLE))"})
ele("sca18_chebyshev", lambda: {"d": S.chebyshev(RGB(), RGB2()), "close": S.chebyshev(RGB(), RGB2()) <= 48}, {"d": f"greatest(abs({R} - {G}), abs({G} - {B}), abs({B} - {R}))", "close": f"greatest(abs({R} - {G}), abs({G} - {B}), abs({B} - {R})) <= 48"})
_LUMA = lambda r, g, b: f"(0.2126 * CAST({r} AS DOUBLE) + 0.7152 * CAST({g} AS DOUBLE) + 0.0722 * CAST({b} AS DOUBLE))"
ele("sca19_readable", lambda: {"colour": S.readable(RGB(), RGB2())}, {"colour": f"CASE WHEN abs({_LUMA(R, G, B)} - {_LUMA(G, B, R)}) >= 55 THEN {HEX} WHEN {_LUMA(G, B, R)} >= 128 THEN '#111827' ELSE '#FFFFFF' END"})
ele("sca20_hue_distance", lambda: {"d": S.hue_distance(RED() % 180, GREEN() % 180)}, {"d": f"least(abs({R} % 180 - {G} % 180), 180 - abs({R} % 180 - {G} % 180))"})
_TOP, _SPAN = f"greatest({R}, {G}, {B})", f"CAST(greatest({R}, {G}, {B}) - least({R}, {G}, {B}) AS DOUBLE)"
_RAW = f"(CASE WHEN {_SPAN} = 0 THEN 0.0 WHEN {_TOP} = {R} THEN 60 * ({G} - {B}) / {_SPAN} WHEN {_TOP} = {G} THEN 120 + 60 * ({B} - {R}) / {_SPAN} ELSE 240 + 60 * ({R} - {G}) / {_SPAN} END)"
ele("sca21_hsv", lambda: {k: c.cast("long") for k, c in zip("hsv", S.hsv(*RGB()), strict=True)}, {"h": f"CAST(floor(({_RAW} + CASE WHEN {_RAW} < 0 THEN 360.0 ELSE 0.0 END) / 2 + 0.5) AS BIGINT) % 180", "s": f"CAST(CASE WHEN {_TOP} = 0 THEN 0 ELSE floor(255 * {_SPAN} / greatest({_TOP}, 1) + 0.5) END AS BIGINT)", "v": f"CAST({_TOP} AS BIGINT)"})
ele("sca22_quantise", lambda: {"bucket": S.quantised(*RGB())}, {"bucket": f"(least(({R} + 8) // 16, 15) << 8) | (least(({G} + 8) // 16, 15) << 4) | least(({B} + 8) // 16, 15)"})
ocr("sca23_numeric_id", lambda: {"n": S.digits(F.col("id")), "none": S.digits(F.col("role"))}, {"n": "TRY_CAST(regexp_replace(id, '[^0-9]', '', 'g') AS BIGINT)", "none": "TRY_CAST(regexp_replace(role, '[^0-9]', '', 'g') AS BIGINT)"})
ele("sca24_component_type", lambda: {"kind": S.lookup(F.col("type"), {"rectangle": "card", "ellipse": "badge", "line": "connector"}, F.col("type"))}, {"kind": "CASE type WHEN 'rectangle' THEN 'card' WHEN 'ellipse' THEN 'badge' WHEN 'line' THEN 'connector' ELSE type END"})
ocr("sca25_font_precedence", lambda: {"kind": F.when((F.col("role") == "main_title") & (F.col("pos") % 2 == 0), "serif").otherwise(S.font_class(T(), F.col("role")))}, {"kind": "CASE WHEN role = 'main_title' AND pos % 2 = 0 THEN 'serif' WHEN regexp_matches(text, '^[0-9\\s.,%+\\-/:]+$') THEN 'monospace' WHEN role = 'main_title' THEN 'display' WHEN role = 'caption' THEN 'serif' ELSE 'sans' END"})
_V = "CASE WHEN pos % 4 = 0 THEN 0.0 ELSE confidence END"
ele("sca26_confidence", lambda: {"c": S.final_confidence(F.when(F.col("pos") % 4 == 0, 0.0).otherwise(F.col("confidence")), F.lit(0.8), F.col("z_index") / 25)}, {"c": f"least(greatest(CASE WHEN {_V} > 0 THEN 0.35 * {_V} + CAST(0.4 AS DOUBLE) * 0.8 + 0.25 * (z_index / 25) ELSE z_index / 25 END, 0.0), 1.0)"})
doc("sca28_mask_key", lambda: {"masked": S.mask_key(F.left(F.md5(T()), (F.col("doc_id") % 20 + 3).cast("int")))}, {"masked": "CASE WHEN doc_id % 20 + 3 <= 8 THEN left(md5(text), 2) || '***' ELSE left(md5(text), 5) || repeat('*', CAST(doc_id % 20 + 3 - 8 AS INT)) || right(left(md5(text), CAST(doc_id % 20 + 3 AS INT)), 3) END"})
pay("sca31_probability", lambda: {"p": S.probability(F.col("probability"))}, {"p": "CASE probability WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE coalesce(CASE WHEN (CASE WHEN k % 6 = 3 OR TRY_CAST(replace(probability, '%', '') AS DOUBLE) > 1 THEN TRY_CAST(replace(probability, '%', '') AS DOUBLE) / 100 ELSE TRY_CAST(replace(probability, '%', '') AS DOUBLE) END) BETWEEN 0 AND 1 THEN (CASE WHEN k % 6 = 3 OR TRY_CAST(replace(probability, '%', '') AS DOUBLE) > 1 THEN TRY_CAST(replace(probability, '%', '') AS DOUBLE) / 100 ELSE TRY_CAST(replace(probability, '%', '') AS DOUBLE) END) END, 0.5) END"})
pay("sca32_plan_score", lambda: {"s": S.plan_score(F.col("probability"))}, {"s": "CASE probability WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.8 ELSE CASE WHEN TRY_CAST(probability AS DOUBLE) IS NULL THEN NULL WHEN TRY_CAST(probability AS DOUBLE) > 1 AND TRY_CAST(probability AS DOUBLE) <= 3 THEN TRY_CAST(probability AS DOUBLE) / 3 ELSE least(greatest(TRY_CAST(probability AS DOUBLE), 0.0), 1.0) END END"})
pay("sca33_font_weight", lambda: {"w": S.font_weight(F.col("weight"))}, {"w": "CASE weight WHEN 'bold' THEN 700 WHEN 'regular' THEN 400 WHEN '650' THEN 600 END"})
pay("sca34_alignment", lambda: {"a": S.alignment(F.col("alignment"))}, {"a": "CASE lower(alignment) WHEN 'centre' THEN 'center' WHEN 'right' THEN 'right' ELSE 'left' END"})
pay("sca36_keep_objects", lambda: {"n": F.size(F.filter(F.array(F.col("probability"), F.col("weight"), F.col("alignment")), lambda x: x.isNotNull())).cast("long")}, {"n": "CAST(1 + CAST(weight IS NOT NULL AS INT) + CAST(alignment IS NOT NULL AS INT) AS BIGINT)"})
pay("sca42_first_set", lambda: {"proxy": F.coalesce(F.col("weight"), F.col("alignment"), F.lit("direct"))}, {"proxy": "coalesce(weight, alignment, 'direct')"})
doc("sca43_asset_name", lambda: {"name": S.asset_name(F.concat(F.lit("/media/"), F.when(F.col("doc_id") % 7 == 0, "../").otherwise(""), F.col("source"), F.lit("/a"), F.col("doc_id").cast("string"), F.lit(".png?v=1/2")))}, {"name": "CASE WHEN doc_id % 7 <> 0 THEN 'a' || CAST(doc_id AS VARCHAR) || '.png' END"})
pay("sca44_number", lambda: {"n": S.number(F.col("weight"))}, {"n": "coalesce(TRY_CAST(weight AS DOUBLE), 0.0)"})
pay("sca45_clamped", lambda: {"n": S.clamped(F.col("probability"), 0.0, 1.0, 0.5)}, {"n": "CASE WHEN TRY_CAST(probability AS DOUBLE) IS NULL THEN 0.5 ELSE least(greatest(TRY_CAST(probability AS DOUBLE), 0.0), 1.0) END"})
ocr("sca47_size_for_width", lambda: {"size": (F.col("x2") - F.col("x1")) / F.greatest(S.line_width(T(), F.lit(1.0)), F.lit(1.0)) * 0.97}, {"size": "(x2 - x1) / greatest(length(text) * 1.0 * 0.56, 1.0) * 0.97"})
doc("sca48_masked", lambda: {"masked": F.concat(F.when(F.col("doc_id") % 2 == 0, "masked:").otherwise(""), F.col("source")).rlike("^masked:|\\*")}, {"masked": "doc_id % 2 = 0"})

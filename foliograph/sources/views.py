"""Layout tables derived from the driver's tables, by integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty elements a page on a 960 x 540 canvas, made of events; edges are x1, y1, x2, y2."""
    cols = {
        "page_id": "cast(floor(event_id / 40.0) as bigint)",
        "element_id": "event_id",
        "pos": "cast(event_id % 40 as int)",
        "type": "CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'image' WHEN 'purchase' THEN 'rectangle' WHEN 'signup' THEN 'ellipse' ELSE 'line' END",
        "x1": "cast((event_id * 37 + user_id * 101) % 920 as double)",
        "y1": "cast((event_id * 53 + user_id * 17) % 500 as double)",
        "width": "cast(8 + (event_id * 13 + user_id * 7) % 200 as double)",
        "height": "cast(8 + (event_id * 29 + user_id * 3) % 72 as double)",
        "z_index": "cast((event_id * 7) % 26 as int)",
        "confidence": "cast((event_id * 7) % 101 as double) / 100",
        "text": "CASE WHEN event_type = 'click' THEN concat('w', cast(user_id % 12 as string)) END",
        "group_id": "CASE WHEN event_id % 3 = 0 THEN concat('g', cast(user_id % 5 as string)) END",
        "suppressed": "event_id % 11 = 0",
        "owned_by": "CASE WHEN event_id % 17 = 0 THEN event_id + 1 END",
    }
    made = table(spark, sf_dir, "events").selectExpr(*(f"{sql} AS {name}" for name, sql in cols.items()))
    return made.withColumns({"x2": F.col("x1") + F.col("width"), "y2": F.col("y1") + F.col("height"), "visible": ~F.col("suppressed") & F.col("owned_by").isNull()})


#: The same for DuckDB, as the common table expression e.
ELEMENTS = """
e0 AS (SELECT CAST(floor(event_id / 40.0) AS BIGINT) AS page_id, event_id AS element_id, CAST(event_id % 40 AS INT) AS pos,
  CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'image' WHEN 'purchase' THEN 'rectangle' WHEN 'signup' THEN 'ellipse' ELSE 'line' END AS type,
  CAST((event_id * 37 + user_id * 101) % 920 AS DOUBLE) AS x1, CAST((event_id * 53 + user_id * 17) % 500 AS DOUBLE) AS y1,
  CAST(8 + (event_id * 13 + user_id * 7) % 200 AS DOUBLE) AS width, CAST(8 + (event_id * 29 + user_id * 3) % 72 AS DOUBLE) AS height,
  CAST((event_id * 7) % 26 AS INT) AS z_index, CAST((event_id * 7) % 101 AS DOUBLE) / 100 AS confidence,
  CASE WHEN event_type = 'click' THEN concat('w', CAST(user_id % 12 AS VARCHAR)) END AS text,
  CASE WHEN event_id % 3 = 0 THEN concat('g', CAST(user_id % 5 AS VARCHAR)) END AS group_id,
  event_id % 11 = 0 AS suppressed, CASE WHEN event_id % 17 = 0 THEN event_id + 1 END AS owned_by FROM events),
e AS (SELECT *, x1 + width AS x2, y1 + height AS y2, NOT suppressed AND owned_by IS NULL AS visible FROM e0)"""


ROLES = "title,subtitle,body_text,caption,label,logo,decorative_text,badge,icon,flow_step,process_arrow,container,card_title,chart"
STRATEGIES = "editable,whole_image,hybrid,native_shape,background,movable_image,mystery,ignore"


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elements with a role, a strategy and measures of their pixels."""
    x1, y1, w, h = (f"cast({c} as bigint)" for c in ("x1", "y1", "width", "height"))
    cols = {
        "role": f"element_at(split('{ROLES}', ','), cast((element_id * 5 + {x1}) % 14 + 1 as int))",
        "strategy": f"element_at(split('{STRATEGIES}', ','), cast((element_id * 3 + {y1}) % 8 + 1 as int))",
        "complexity": f"cast((element_id * 11 + {x1}) % 100 as double) / 100",
        "fill": f"cast((element_id * 17 + {w}) % 100 as double) / 100",
        "alike": f"cast((element_id * 31 + {y1}) % 100 as double) / 100",
        "saturation": f"(element_id * 19 + {h}) % 256",
        "delta": f"(element_id * 23 + {x1}) % 256",
        "intrinsic": f"cast(8 + (element_id * 3 + {w}) % 90 as double) / cast(8 + (element_id * 7 + {h}) % 40 as double)",
        "art": "element_id % 13 = 0", "whole": "element_id % 4 = 0", "near_twin": "element_id % 6 = 1",
    }
    return elements(spark, sf_dir).selectExpr("*", *(f"{sql} AS {name}" for name, sql in cols.items()))


RICH = f"""x AS (SELECT *, string_split('{ROLES}', ',')[CAST((element_id * 5 + CAST(x1 AS BIGINT)) % 14 + 1 AS INT)] AS role, string_split('{STRATEGIES}', ',')[CAST((element_id * 3 + CAST(y1 AS BIGINT)) % 8 + 1 AS INT)] AS strategy,
  CAST((element_id * 11 + CAST(x1 AS BIGINT)) % 100 AS DOUBLE) / 100 AS complexity, CAST((element_id * 17 + CAST(width AS BIGINT)) % 100 AS DOUBLE) / 100 AS fill, CAST((element_id * 31 + CAST(y1 AS BIGINT)) % 100 AS DOUBLE) / 100 AS alike,
  (element_id * 19 + CAST(height AS BIGINT)) % 256 AS saturation, (element_id * 23 + CAST(x1 AS BIGINT)) % 256 AS delta,
  CAST(8 + (element_id * 3 + CAST(width AS BIGINT)) % 90 AS DOUBLE) / CAST(8 + (element_id * 7 + CAST(height AS BIGINT)) % 40 AS DOUBLE) AS intrinsic,
  element_id % 13 = 0 AS art, element_id % 4 = 0 AS whole, element_id % 6 = 1 AS near_twin FROM e)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 grey tile for each embedding: page_id, px, py, v."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return long.selectExpr("vec_id AS page_id", "cast(p % 8 as int) AS px", "cast(floor(p / 8.0) as int) AS py", "cast(floor((cast(e as double) + 1) * 127.5) as int) AS v")


PIXELS = """
px AS (SELECT vec_id AS page_id, CAST(p % 8 AS INT) AS px, CAST(floor(p / 8.0) AS INT) AS py, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INT) AS v
  FROM (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(embedding) AS e FROM embeddings))"""


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recognised lines: a page for each, a line for each turn."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS page_id", "cast(turn as int) AS pos", "concat('text_', cast(turn as string)) AS id", "text",
        "cast(40 + 300 * (turn % 2) as double) AS x1", "cast(20 + 26 * turn as double) AS y1",
        "cast(40 + 300 * (turn % 2) + 4 + length(text) % 260 as double) AS x2", "cast(20 + 26 * turn + 14 + length(text) % 9 as double) AS y2",
        "CASE role WHEN 'system' THEN 'main_title' WHEN 'user' THEN 'body_text' ELSE 'caption' END AS role",
    )


OCR_LINES = """
o AS (SELECT conv_id AS page_id, CAST(turn AS INT) AS pos, concat('text_', CAST(turn AS VARCHAR)) AS id, text,
  CAST(40 + 300 * (turn % 2) AS DOUBLE) AS x1, CAST(20 + 26 * turn AS DOUBLE) AS y1,
  CAST(40 + 300 * (turn % 2) + 4 + length(text) % 260 AS DOUBLE) AS x2, CAST(20 + 26 * turn + 14 + length(text) % 9 AS DOUBLE) AS y2,
  CASE role WHEN 'system' THEN 'main_title' WHEN 'user' THEN 'body_text' ELSE 'caption' END AS role FROM conversations)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untidy values as a model would return them, made of events: k, probability, weight, alignment."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).selectExpr(
        "event_id", "k",
        "CASE k % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN concat(cast(k as string), '%') WHEN 4 THEN cast(k as string) ELSE concat('0.', cast(k as string)) END AS probability",
        "CASE k % 5 WHEN 0 THEN 'bold' WHEN 1 THEN 'regular' WHEN 2 THEN '650' WHEN 3 THEN 'x' END AS weight",
        "CASE k % 4 WHEN 0 THEN 'Centre' WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'justify' END AS alignment",
    )


PAYLOADS = """
k0 AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
k AS (SELECT event_id, k,
  CASE k % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN concat(CAST(k AS VARCHAR), '%') WHEN 4 THEN CAST(k AS VARCHAR) ELSE concat('0.', CAST(k AS VARCHAR)) END AS probability,
  CASE k % 5 WHEN 0 THEN 'bold' WHEN 1 THEN 'regular' WHEN 2 THEN '650' WHEN 3 THEN 'x' END AS weight,
  CASE k % 4 WHEN 0 THEN 'Centre' WHEN 1 THEN 'RIGHT' WHEN 2 THEN 'justify' END AS alignment FROM k0)"""

"""Queries of pixel operators and of connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as P
from ..sources.views import PIXELS, pixels
from .registry import add, query

INK = "v >= 136"
KEY = ["page_id", "px", "py"]


def shifted(p: DataFrame) -> DataFrame:
    """A preview of a tile: the tile itself a pixel to the right, somewhat lighter."""
    return p.where("px < 7").select("page_id", (F.col("px") + 1).alias("px"), "py", (F.col("v") + 3).alias("v"))


CTE = f"WITH {PIXELS}, w0 AS (SELECT page_id, px + 1 AS px, py, v + 3 AS v FROM px WHERE px < 7), c AS (SELECT px.*, w0.v AS w FROM px JOIN w0 ON px.page_id = w0.page_id AND px.px = w0.px AND px.py = w0.py)"


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return P.compared(p, shifted(p))


def tile(name: str, run, sql: str) -> None:
    add(name, lambda spark, sf_dir: run(pixels(spark, sf_dir)), f"WITH {PIXELS} {sql}")


def pair(name: str, run, sql: str) -> None:
    add(name, lambda spark, sf_dir: run(both(spark, sf_dir)), f"{CTE} {sql}")


def diff() -> Column:
    return F.col("v") - F.col("w")


tile("ras01_mask", lambda p: p.where((F.col("v") >= 150) | ((F.col("v") < 100) & (F.col("px") > 2))).select(*KEY), "SELECT page_id, px, py FROM px WHERE v >= 150 OR (v < 100 AND px > 2)")
pair("ras02_difference", lambda c: c.groupBy("page_id").agg(F.avg(F.abs(diff())).alias("mean"), P.similarity((diff() * diff()).cast("double")).alias("similarity")), "SELECT page_id, avg(abs(v - w)) AS mean, 1 / (1 + avg(CAST((v - w) * (v - w) AS DOUBLE)) / 65025.0) AS similarity FROM c GROUP BY page_id")
pair("ras03_masked_similarity", lambda c: c.groupBy("page_id").agg(P.masked_mean(1 - F.abs(diff()) / 255, F.col("v") >= 180, 1.0).alias("s")).select("page_id", F.floor(F.col("s") * 1e9).cast("long").alias("s")), "SELECT page_id, CAST(floor(coalesce(avg(CASE WHEN v >= 180 THEN 1 - abs(v - w) / 255 END), 1.0) * 1e9) AS BIGINT) AS s FROM c GROUP BY page_id")
tile("ras04_element_mask", lambda p: p.where("px BETWEEN page_id % 4 AND page_id % 4 + 3 AND py BETWEEN 2 AND 5").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("v").alias("s")), "SELECT page_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM px WHERE px BETWEEN page_id % 4 AND page_id % 4 + 3 AND py BETWEEN 2 AND 5 GROUP BY page_id")
pair("ras05_colour_similarity", lambda c: c.groupBy("page_id").agg((1 - F.abs(F.avg("v") - F.avg("w")) / 255.0).alias("s")), "SELECT page_id, 1 - abs(avg(v) - avg(w)) / 255.0 AS s FROM c GROUP BY page_id")
tile("ras07_border", lambda p: p.where("px IN (0, 7) OR py IN (0, 7)").groupBy("page_id").agg(F.median("v").alias("border")), "SELECT page_id, median(v) AS border FROM px WHERE px IN (0, 7) OR py IN (0, 7) GROUP BY page_id")


@query("ras08_candidate_mask", f"WITH {PIXELS}, b AS (SELECT page_id, median(v) AS border FROM px WHERE px IN (0, 7) OR py IN (0, 7) GROUP BY page_id) SELECT px.page_id, px, py FROM px JOIN b ON px.page_id = b.page_id WHERE abs(v - border) >= 20")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that stand off the colour of their tile's border."""
    p = pixels(spark, sf_dir)
    border = p.where("px IN (0, 7) OR py IN (0, 7)").groupBy("page_id").agg(F.median("v").alias("border"))
    return p.join(border, "page_id").where(F.abs(F.col("v") - F.col("border")) >= 20).select(*KEY)


_NEAR = "abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1"
tile("ras11_dilate", lambda p: P.dilated(p, F.expr(INK)), f"SELECT DISTINCT a.page_id, a.px, a.py FROM px a JOIN px b ON a.page_id = b.page_id AND {_NEAR} WHERE b.{INK}")
tile("ras11_erode", lambda p: P.eroded(p, F.expr(INK)), f"SELECT page_id, px, py FROM px a WHERE a.{INK} AND NOT EXISTS (SELECT 1 FROM px b WHERE a.page_id = b.page_id AND {_NEAR} AND NOT b.{INK})")
tile("ras13_background_profile", lambda p: p.where("px IN (0, 7) OR py IN (0, 7)").groupBy("page_id").agg(F.median("v").alias("mid"), F.max("v").alias("hi"), F.min("v").alias("lo")).select("page_id", "mid", F.when(F.col("hi") - F.col("lo") < 40, "solid").when(F.col("hi") - F.col("lo") < 80, "gradient").otherwise("complex").alias("kind")), "SELECT page_id, mid, CASE WHEN hi - lo < 40 THEN 'solid' WHEN hi - lo < 80 THEN 'gradient' ELSE 'complex' END AS kind FROM (SELECT page_id, median(v) AS mid, max(v) AS hi, min(v) AS lo FROM px WHERE px IN (0, 7) OR py IN (0, 7) GROUP BY page_id)")
pair("ras15_mask_f1", lambda c: c.groupBy("page_id").agg(F.count_if(F.expr(INK) & (F.col("w") >= 136)).alias("tp"), F.count_if(F.expr(INK)).alias("a"), F.count_if(F.col("w") >= 136).alias("b")).select("page_id", (2 * F.col("tp") / F.greatest(F.col("a") + F.col("b"), F.lit(1))).alias("f1")), f"SELECT page_id, 2 * count_if({INK} AND w >= 136) / greatest(count_if({INK}) + count_if(w >= 136), 1) AS f1 FROM c GROUP BY page_id")
pair("ras16_changed_centroid", lambda c: c.where(F.abs(diff()) > 12).groupBy("page_id").agg(F.count("*").alias("n"), F.median("px").alias("mx"), F.median("py").alias("my")), "SELECT page_id, count(*) AS n, median(px) AS mx, median(py) AS my FROM c WHERE abs(v - w) > 12 GROUP BY page_id")
pair("ras17_edges_retained", lambda c: c.where(INK).groupBy("page_id").agg((F.count_if(F.abs(diff()) <= 8) / F.count("*")).alias("share")), f"SELECT page_id, count_if(abs(v - w) <= 8) / count(*) AS share FROM c WHERE {INK} GROUP BY page_id")
pair("ras23_agreement", lambda c: c.groupBy("page_id").agg((F.count_if(F.abs(diff()) <= 16) / F.count("*") >= 0.6).alias("agrees")), "SELECT page_id, count_if(abs(v - w) <= 16) / count(*) >= 0.6 AS agrees FROM c GROUP BY page_id")
tile("win13_runs", lambda p: P.runs(p, F.expr(INK)), f"SELECT page_id, py, min(px) AS first, max(px) AS last FROM (SELECT *, px - row_number() OVER (PARTITION BY page_id, py ORDER BY px) AS island FROM px WHERE {INK}) GROUP BY page_id, py, island")
# a page's labels go round by round to the least label among neighbours; UNION drops what is known already
ITR02 = f"""WITH RECURSIVE {PIXELS}, m AS (SELECT page_id, px, py, CAST(py AS BIGINT) * 1000000 + px AS id FROM px WHERE {INK}),
r AS (SELECT page_id, id AS root, id, px, py FROM m
  UNION SELECT a.page_id, r.root, a.id, a.px, a.py FROM r JOIN m a ON a.page_id = r.page_id AND abs(a.px - r.px) <= 1 AND abs(a.py - r.py) <= 1)
SELECT page_id, px, py, min(root) AS label FROM r GROUP BY page_id, px, py"""
add("itr02_components", lambda s, d: P.components(pixels(s, d), F.expr(INK)), ITR02)
add("itr03_holes", lambda s, d: P.components(pixels(s, d), F.expr("v < 136")).groupBy("page_id", "label").agg(F.count("*").alias("size"), F.bool_or(F.col("px").isin(0, 7) | F.col("py").isin(0, 7)).alias("open")).where("NOT open").select("page_id", "label", "size"),
    ITR02.replace(INK, "v < 136").replace("SELECT page_id, px, py, min(root) AS label FROM r GROUP BY page_id, px, py", ", l AS (SELECT page_id, px, py, min(root) AS label FROM r GROUP BY page_id, px, py) SELECT page_id, label, count(*) AS size FROM l GROUP BY page_id, label HAVING NOT bool_or(px IN (0, 7) OR py IN (0, 7))"))

# shapes, profiles, audits
_ELLIPSE = "(px - 3.5) * (px - 3.5) / 12.25 + (py - 3.5) * (py - 3.5) / 9.0 <= 1.0"
tile("ras49_ellipse_mask", lambda p: p.where(_ELLIPSE).groupBy("page_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), f"SELECT page_id, count(*) AS n, avg(v) AS mean FROM px WHERE {_ELLIPSE} GROUP BY page_id")

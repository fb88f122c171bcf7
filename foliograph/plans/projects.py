"""Projects: pages through folders, and state by project from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from ..sources.projects import read_projects, write_projects
from ..sources.views import ELEMENTS, elements, table
from ..streaming import projects as live
from .registry import query


@query("snk01_project_pages", f"WITH {ELEMENTS} SELECT lower(to_hex(page_id // 8)) AS project, CAST(page_id % 8 + 1 AS INTEGER) AS page, count(*) AS n, CAST(sum(pos) AS BIGINT) AS at, max(type) AS last FROM e GROUP BY page_id")
def project_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a document in its project's folder: written by tasks, renamed by the commit, and read again, a partition for each project."""
    e = elements(spark, sf_dir).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "type"))).alias("elements"))
    pages = e.select(F.lower(F.hex(F.expr("page_id div 8"))).alias("project"), (F.col("page_id") % 8 + 1).cast("int").alias("page"), F.to_json(F.struct("elements")).alias("document"))
    root = new_folder(spark, "projects")
    write_projects(pages, root)
    found = read_projects(spark, root).withColumn("e", F.from_json("document", "elements array<struct<pos:bigint,type:string>>")["elements"])
    return found.select("project", "page", F.size("e").cast("long").alias("n"), F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + x["pos"]).alias("at"), F.array_max("e.type").alias("last"))


_KINDS = ("image", "approve", "stage", "accept", "discard")


@query(
    "sta01_keyed_projects",
    """WITH v AS (SELECT event_id // 320 AS project, CAST(event_id * 7 % 9 + 1 AS INTEGER) AS value, event_id % 5 AS k FROM events)
    SELECT project, count_if(k = 0) AS images, coalesce(string_agg(DISTINCT CAST(value AS VARCHAR), ',' ORDER BY CAST(value AS VARCHAR)) FILTER (k = 1), '') AS approved, CAST(coalesce(max(CASE WHEN k = 3 THEN value END), 0) AS INTEGER) AS version FROM v GROUP BY project""",
)
def keyed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's images, approved pages and version after all events have come through the stream."""
    schema = table(spark, sf_dir, "events").schema
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 5 + 1).cast("int"))
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern may name a file as well as a folder
    events = stream.select(F.expr("event_id div 320").alias("project"), kind.alias("kind"), F.col("event_id").alias("id"), (F.col("event_id") * 7 % 9 + 1).cast("int").alias("value"), F.timestamp_seconds(1_700_000_000 + F.col("event_id")).alias("ts"))
    at = new_folder(spark, "state")
    live.kept(events, f"{at}/rows", f"{at}/checkpoint")
    return live.newest(spark.read.parquet(f"{at}/rows")).select("project", "images", "approved", "version")

"""Layout documents, images and assets as files that Spark reads and writes."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .projects import local

#: An element of a page document; what else its metadata has stays in a map.
ELEMENT = """id string, type string, x double, y double, width double, height double, rotation double, zIndex int, text string, src string, role string, groupId string, confidence double,
style struct<fontSize:double,fontFamily:string,fontWeight:int,color:string,fill:string,stroke:string,strokeWidth:double,opacity:double,align:string>, metadata map<string,string>"""
PAGE = f"version string, slide struct<width:double,height:double>, source string, backgroundUrl string, elements array<struct<{ELEMENT.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int').replace(' struct<', ':struct<').replace(' map<', ':map<')}>>"
IMAGES = ("png", "jpg", "jpeg", "webp")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_no and the document of every page_N.json under path, in page order."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    pages = spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.json").json(path)
    return pages.select(F.regexp_extract(name, r"(\d+)\.json$", 1).cast("int").alias("page_no"), "*").orderBy("page_no")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """A row for each element of each page, pos its place in the document."""
    return read_pages(spark, path).select("page_no", F.posexplode("elements").alias("pos", "e")).select("page_no", "pos", "e.*")


def write_elements(elements: DataFrame, path: str) -> None:
    """Elements by page; pages that aren't in the table stay as they are."""
    elements.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page_no").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """name, content and sha256 of the image files under path; other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(F.element_at(F.split(name, "\\."), -1)).isin(*IMAGES)).select(name.alias("name"), "length", "content", F.sha2("content", 256).alias("sha256"))


def localised_name(name: Column, content: Column) -> Column:
    """The name under which a foreign asset is kept: its stem and 12 digits of its content's hash."""
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("_"), F.left(F.sha2(content, 256), F.lit(12)), F.regexp_extract(name, r"(\.[^.]+)$", 1))


#: Folders that the pages' folders are dealt over, so that each is listed by a task and never all by the driver; the name of what has no page; documents that a task hands on at a time.
DEALT, NO_PAGE, AT_ONCE = 1024, "__HIVE_DEFAULT_PARTITION__", 256


def write_folders(pages: DataFrame, root: str) -> int:
    """Each row (page_id, document) as <root>/<part>/page_id=<n>/rows.json by the tasks, and how many there were; root is mounted wherever tasks run.

    A folder is written under another name and then renamed, so it is complete or not there. A page that is there already stays.
    """
    root = local(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, document in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = os.path.join(root, f"{(page or 0) % DEALT:03x}")
                name = f"page_id={NO_PAGE if page is None else page}"
                new = os.path.join(part, f".{name}.{uuid.uuid4().hex}")
                os.makedirs(new)
                with open(os.path.join(new, "rows.json"), "w", encoding="utf-8") as file:
                    file.write(document.as_py())
                try:
                    os.rename(new, os.path.join(part, name))
                except OSError:
                    if not os.path.isdir(os.path.join(part, name)):
                        raise
                    shutil.rmtree(new)  # another attempt of the task was there before
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return pages.select("page_id", "document").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_folders(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, document) of all that write_folders() put under root."""
    root = local(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (os.path.join(root, f"{k:03x}") for k in batch.column(0).to_pylist()):
                names = [n for n in os.listdir(part) if n.startswith("page_id=")] if os.path.isdir(part) else []
                for begin in range(0, len(names), AT_ONCE):
                    pages, documents = [], []
                    for name in names[begin : begin + AT_ONCE]:
                        with open(os.path.join(part, name, "rows.json"), encoding="utf-8") as file:
                            documents.append(file.read())
                        number = name.partition("=")[2]
                        pages.append(None if number == NO_PAGE else int(number))
                    yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(documents, pa.string())], names=["page_id", "document"])

    parts = min(DEALT, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, DEALT, 1, parts).mapInArrow(run, "page_id bigint, document string")


def report(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, as the report files hold them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def may_be_fetched(name: Column) -> Column:
    """Whether a file may be handed out: a fixed report name or a numbered page file."""
    return name.isin("scene_raw.json", "scene_refined.json", "score.json", "preview.png") | name.rlike(r"^[a-z_]+_[1-9][0-9]*\.(png|json)$")


def repaired_urls(elements: DataFrame, kept: DataFrame) -> DataFrame:
    """elements with src pointing at a kept file of the same name where one is; kept has name and url. Other columns pass through, whatever their names."""
    taken = {c.lower() for c in elements.columns}
    own, new = (next(n for k in range(len(taken) + 1) if (n := "_" * k + base) not in taken) for base in ("kept_name", "kept_url"))
    found = kept.select(F.col("name").alias(own), F.col("url").alias(new))
    name = F.regexp_extract("src", r"([^/?]+)(?:\?.*)?$", 1)
    return elements.withColumn(own, name).join(found, own, "left").withColumn("src", F.coalesce(new, "src")).drop(own, new)

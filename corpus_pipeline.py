"""The corpus pipeline: each stage takes what the one before it kept, written as Parquet and read again.

Rows without an id or a text, repeated rows, texts of any length, empty tables and further columns go through as the
operators' docstrings say; all stages but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm._common import spare
from foliograph.llm.line_dedup import line_dedup
from foliograph.llm.mixing import mix
from foliograph.llm.near_duplicates import keep_one
from foliograph.llm.quality import quality_rules
from foliograph.llm.sentencepieces import encode_column
from foliograph.session import new_folder

#: Shares of tokens after mixing.
TARGETS = {"clean": 0.99, "toxic": 0.01}
#: No SQL can run the sketches, the fit and the tokenizer; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; a null or empty text fails them."""
    (verdict,) = spare(docs, "quality")
    return quality_rules(docs, out_col=verdict).where(f"{verdict}.kept").drop(verdict)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the line chunks that a document before it has; n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of every class of near duplicates."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier clean than toxic once, and of the others as many as the share of toxic tokens allows.

    That share is an upper bound: where it isn't reached nothing goes, and nothing is repeated.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domain = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    mixed_col, copy = spare(docs, "mix", "copy")
    mixed = mix(docs, labels.select("doc_id", domain.alias("domain")), TARGETS, out_col=mixed_col, whole="clean", once=True)
    return mixed.where(f"{mixed_col}.copies > 0").withColumn(copy, F.explode(F.expr(f"sequence(1, {mixed_col}.copies)"))).drop(mixed_col, copy)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every document."""
    return encode_column(docs.select("doc_id", "text")).select("doc_id", "pieces.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; stages are stored in the shared checkpoint folder until the driver ends."""
    at = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs

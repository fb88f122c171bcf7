"""Shared pieces of the operators: let-bindings, table access, lineage cuts."""

from __future__ import annotations

import os

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import cut, stored

__all__ = ["cut", "let", "here", "read", "ship", "spare", "stored", "words_of"]

#: Words are runs of characters other than the ASCII white space 0x20 and 0x09-0x0D.
SPACE = "[ \\t-\\r]+"


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """names, each with so many _ before it that df has no column of that name."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def ship(spark: SparkSession, path: str) -> str:
    """Has executors fetch a file of the driver's; here() finds it in a task. A path that the driver lacks is left for executors to have."""
    if os.path.isfile(path):
        spark.sparkContext.addFile(path)
    return path


def here(path: str) -> str:
    """Where a task finds a file that ship() was given."""
    try:
        fetched = SparkFiles.get(os.path.basename(path))
    except Exception:  # no Spark in this process
        return path
    return fetched if os.path.isfile(fetched) else path

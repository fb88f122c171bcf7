"""Operators on the order of a page's rows: windows where the rule looks back one row, folds where it looks at all it has decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """(page_id, rows): a page's rows as an array of structs in order; a page is the bounded unit of layout work."""
    names = [*order, *(f for f in fields if f not in order)]
    return df.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))


def overlap_of(a: Column, b: Column) -> Column:
    """Common area over the smaller area of two box structs."""
    common = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return common / F.greatest(F.least(size(a), size(b)), F.lit(1.0))


def select_greedily(df: DataFrame, order: list[str], clashes: Callable[[Column, Column], Column], fields: list[str], most: int | None = None) -> DataFrame:
    """(page_id, pos) of rows taken in order, each unless it clashes with one taken before; `most` of a page if that is given."""
    pages = ordered(df, order, ["pos", *fields])
    kind = pages.schema["rows"].dataType.simpleString()
    taken = F.aggregate("rows", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) >= (most or 2**31 - 1)) | F.exists(acc, lambda y: clashes(y, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return pages.select("page_id", F.explode(taken).alias("x")).select("page_id", F.col("x.pos").alias("pos"))


def islands(df: DataFrame, breaks: Callable[[Column], Column], order: str = "pos") -> DataFrame:
    """df with block: rows in order, a new block where breaks(previous row) holds; previous is a struct of all columns."""
    w = Window.partitionBy("page_id").orderBy(order)
    now = df.withColumn("__prev", F.lag(F.struct(*df.columns)).over(w))
    new = F.when(F.col("__prev").isNull() | breaks(F.col("__prev")), 1).otherwise(0)
    return now.withColumn("__new", new).withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__prev", "__new")

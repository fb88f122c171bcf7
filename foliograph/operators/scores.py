"""Aggregates of pages: buckets, coverage, scores, issue counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def buckets(df: DataFrame, by: Mapping[str, Column], least: int = 2) -> DataFrame:
    """Members of a page that share what `by` says, as a comma-joined list in order, if there are enough."""
    out = df.select("page_id", "pos", *(c.alias(n) for n, c in by.items())).groupBy("page_id", *by).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("pos")).cast("array<string>"), ",").alias("members"))
    return out.where(F.col("n") >= least)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight by the sum of weights, which counts as 1 at least."""
    return F.sum(value * weight) / F.greatest(F.lit(1.0), F.sum(weight))


def capped(count: Column, each: float, most: float) -> Column:
    """A penalty for each of a count, up to a most."""
    return F.least(count * each, F.lit(most))


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def mode_first(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each key the most frequent value, the least of equals; nulls don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    return n.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*key, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))
